"""Personal items in free text, found by a semi-Markov conditional random field, and replaced by typed placeholders.

A text is segmented into items (email, phone, id_number, address, person) and everything else. Segments are whole spans: for each
type a grammar proposes every span that could be one (bounded to `LONGEST` characters), features look at the whole span and
at what surrounds it. The score of a segmentation is the sum of the scores of its items, and of a transition score for each two items that only
separators part ("name; address; number"); the rest scores 0. Dynamic programming over the ends of the spans finds the best set that
doesn't overlap, which decides borders and types jointly. The weights maximise the conditional likelihood of labelled
rows (`train`, on at most `TRAIN_ROWS` rows that `examples` writes from its own templates) and are kept in `pii_weights.json`.

Persons are proposed by shape: two or more capitalised words, an initial and a word, words around a comma, or a known given name and a word of any case.
Which names are known (common given names, and those of a lexicon that the caller gives, in any number) is a feature among
others: case, titles, what introduces the name, what follows it, words that end names of places, firms and machines.

Rows are handled one by one where they are: nothing is shuffled but what is found. Tests that the grammars imply skip texts in which they can find nothing.

Defined results: null and empty texts have no items and stay as they are; positions count code points; a text of any length is
scanned whole; repeated rows give the same items; other columns are left alone.
"""

from __future__ import annotations

import base64
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.given_names import NICKNAMES, PLAIN
from tessaline.llm.names import fold, words
from tessaline.llm.spread import spread
from tessaline.runtime import cut

KINDS = ("email", "phone", "id_number", "address", "person")
LONGEST = 160
#: Rows that the weights are fitted to.
TRAIN_ROWS = 16_000


#: Given names of general knowledge, with their short forms of three letters and more.
GIVEN = frozenset(NICKNAMES) | PLAIN | {n for short in NICKNAMES.values() for n in short.split() if len(n) > 2}
#: Lexicon words up to which they travel with the tasks; a larger lexicon is joined to the words of the texts.
CARRIED_WORDS = 200_000


class Names:
    """What is known of names, folded: given names and family names."""

    def __init__(self, given: Iterable[str] = (), families: Iterable[str] = ()):
        self.given, self.families = GIVEN | frozenset(given), frozenset(families)
        self._given: dict[str, bool] = {}
        self._family: dict[str, bool] = {}
        self._lower: dict[str, bool] = {}

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Names:
        """From (entity_name, label) of known entities; given names of general knowledge are added."""
        known = [x for name, label in rows for x in name_words(name, label)]
        return cls([w for w, role in known if role == "given"], [w for w, role in known if role == "family"])

    def is_given(self, word: str) -> bool:
        return self._known(self._given, self.given, word)

    def is_family(self, word: str) -> bool:
        return self._known(self._family, self.families, word)

    @staticmethod
    def _known(seen: dict[str, bool], names: frozenset, word: str) -> bool:
        if word not in seen:
            if len(seen) > 200_000:
                seen.clear()
            seen[word] = all(len(p) > 1 and (fold(p) in names or fold(p, True) in names) for p in word.split("-"))
        return seen[word]

    def hints(self, low: set[str]) -> bool:
        """Whether one of the lower-cased words is a known given name, in lower case too (no common word)."""
        return any(self.in_lower(w) for w in low if w in self.given or not w.isascii())

    def in_lower(self, word: str) -> bool:
        """Whether a word in lower case is taken for a known given name."""
        known = self._lower.get(word)
        if known is None:
            if len(self._lower) > 200_000:
                self._lower.clear()
            known = self._lower[word] = self.is_given(word) and word not in common_words()
        return known


def name_words(name: str, label: str) -> list[tuple[str, str]]:
    """(folded word, given or family) of a person's name; nothing for other entities."""
    out = []
    if label == "PERSON":
        for digraphs in (False, True):
            parts = words(name, digraphs)
            if len(parts) > 1:
                out += [(parts[0], "given"), *((w, "family") for w in parts[1:])]
    return out


@dataclass
class Span:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


_S = r"[\s​]"
_LOCAL = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}._+\-]*"
_LABEL = r"[\p{L}\p{N}][\p{L}\p{N}\-]*"
_AT = rf"(?:{_S}{{0,2}}[@＠]{_S}{{0,2}}|{_S}{{0,2}}[\[({{]{_S}?at{_S}?[\])}}]{_S}{{0,2}})"
_DOT = rf"(?:\.|{_S}{{0,2}}[\[({{]{_S}?dot{_S}?[\])}}]{_S}{{0,2}}|{_S}{{1,2}}dot{_S}{{1,2}})"
_EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.+\-])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*|{_LOCAL}{_S}{{1,2}}at{_S}{{1,2}}{_LABEL}(?:{_S}{{1,2}}dot{_S}{{1,2}}{_LABEL})+)", regex.I)

_SEP = r"(?:[\s​]{1,2}|[\s​]?[.\-–‐‑/])"
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_EDGE = r"(?![\p{L}\p{N}]|[.,\-–/:]\p{N})"
_NUMBERS = {
    "nanp": rf"(?:\+?1{_SEP}?)?(?:\(\d{{3}}\)|\d{{3}}){_SEP}?\d{{3}}{_SEP}?\d{{4}}",
    "world": rf"(?:\+|00){_S}?[1-9]\d{{0,2}}(?:{_SEP}?(?:\(\d{{1,4}}\)|\d{{1,8}})){{1,6}}",
    "plus44": rf"(?:\+|00){_SEP}?44(?:{_SEP}?\(0\))?(?:{_SEP}?\d){{10}}",
    "plus33": rf"(?:\+|00){_SEP}?33(?:{_SEP}?\(0\))?(?:{_SEP}?\d){{9}}",
    "trunk": rf"(?:\(0\d{{1,4}}\)|0\d{{1,4}}){_SEP}\d{{3,5}}(?:{_SEP}\d{{2,4}}){{0,2}}|0\d{{4}}{_SEP}\d{{6}}|0\d{{9,10}}",
    "pairs": rf"0\d(?:{_SEP}\d\d){{4}}",
    "local": rf"\d{{3}}{_SEP}\d{{4}}",
    "spoken": rf"(?:{_DIGIT}(?:[\s\-]+|,[\s]*)){{6,14}}{_DIGIT}",
}
_PHONES = {k: regex.compile(rf"(?<![\p{{L}}\p{{N}}_@#+]|\p{{N}}[.,:/\-–])(?:{p}){_EDGE}", regex.I) for k, p in _NUMBERS.items()}

_IDS = {
    "grouped9": r"\d{3}[\s\-]\d{2}[\s\-]\d{4}",
    "letters_pairs": rf"[A-Z]{{2}}{_S}{{0,2}}\d\d{_S}{{0,2}}\d\d{_S}{{0,2}}\d\d{_S}{{0,2}}[A-Z]",
    "digits_letter": r"\d{8}-?[A-Z]|\d{1,2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]",
    "triples": rf"\d{{2}}(?:{_S}{{1,2}}\d{{3}}){{3}}",
    "french": rf"[12]{_S}{{0,2}}\d\d{_S}{{0,2}}\d\d{_S}{{0,2}}\d[\dAB]{_S}{{0,2}}\d{{3}}{_S}{{0,2}}\d{{3}}(?:{_S}{{0,2}}\d\d)?",
    "licence": r"[A-Z]{1,5}[\d*]{2,6}-\d{3,5}-\d{2,3}",
    "letter_digits": r"[A-Z]{1,2}\d{6,9}",
    "plain": r"\d{9}|\d{11}|\d{13}|\d{15}",
    "other": r"(?=[A-Z0-9\-.]*\d)[A-Z0-9]{2,8}(?:[\-.][A-Z0-9]{2,8}){1,4}",
}
_ID_SHAPES = {k: regex.compile(rf"(?<![\p{{L}}\p{{N}}_@+]|\p{{N}}[.,\-])(?:{p})(?![\p{{L}}\p{{N}}]|[\-]\p{{N}})", regex.I) for k, p in _IDS.items()}
_ID_LABEL = regex.compile(
    r"(?:ssn|social(?:[\s\-]+security)?|nino|(?<!\p{L})(?:ni|dni|nie|nif|nir|tin)|national[\s]+insurance|insee|s[ée]curit[ée][\s]+sociale|steuer[\s\-]?id(?:entifikationsnummer|nr\.?)?|steuernummer|tax[\s\-]*(?:payer)?[\s\-]*id(?:entity|entification)?|itin|curp|"
    r"passport|reisepass|pasaporte|passeport|driv(?:er|ing)['’]?s?[\s]+licen[cs]e|f[üu]hrerschein|permis|national[\s]+id(?:entity)?|identity[\s]+(?:card|number)|(?<!\p{L})id[\s]+card|(?:personal)?ausweis|carte[\s]+d.identit[ée])"
    r"(?:[\s]+(?:card|number|nummer|no|nr|num|id|n[°º]))?\.?[\s:#°º=\-]*$",
    regex.I,
)
_QUOTES = regex.compile(r"[\"“”„«»()\[\]{}*]")
_STREETS = r"(?:street|st|road|rd|lane|ln|avenue|ave|terrace|gardens|gdns|court|ct|drive|blvd|boulevard|close|way|square|sq|place|pl|crescent|row|walk|hill|mews|park)"
_WORDS = rf"(?:(?!(?:the|a|an|and|of|with|to|was|is|in|at|on|for|der|die|das|la|le|el)\b)\p{{L}}[\p{{L}}\p{{M}}'’]*{_S}{{1,3}}){{1,3}}"
_TAIL = (
    rf"(?:\.?,?{_S}{{1,3}}(?:apt|flat|unit|suite|apartment)\.?{_S}{{1,3}}\w+)?(?:,{_S}{{1,3}}\d{{1,2}}[º°ª]{_S}?\p{{L}}?)?"
    rf"(?:\.?[,\s]{_S}{{0,3}}(?:\d{{4,5}}{_S}{{1,3}})?\p{{Lu}}[\p{{L}}'’\-]+)?(?:,?{_S}{{1,3}}(?-i:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}{{1,2}}\d[A-Z]{{2}}|[A-Z]{{2}}{_S}{{1,2}}\d{{5}}))?"
)
_PLACES = {
    "flat": rf"(?:flat|apt|apartment|unit|suite)\.?{_S}{{1,3}}\d+\w?,{_S}{{1,3}}\d+\w?{_S}{{1,3}}{_WORDS}{_STREETS}\b",
    "house": rf"\d{{1,5}}[a-z]?,?{_S}{{1,3}}{_WORDS}{_STREETS}\b",
    "box": rf"p\.?{_S}?o\.?{_S}{{0,3}}box{_S}{{1,3}}\d+|(?:postfach|apartado|bo[iî]te postale|b\.?p\.?){_S}{{1,3}}\d+",
    "german": rf"\p{{L}}[\p{{L}}\-]+(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|ufer){_S}{{1,3}}\d{{1,4}}{_S}?[a-z]?\b",
    "spanish": rf"(?:calle|plaza|avenida|avda\.|av\.|paseo|camino|c/){_S}{{0,3}}(?:de{_S}{{1,3}})?(?:la{_S}{{1,3}}|los{_S}{{1,3}})?\p{{L}}[\p{{L}}'’]+,?{_S}{{1,3}}\d{{1,4}}\b",
    "french": rf"\d{{1,4}}(?:{_S}{{1,3}}(?:bis|ter))?,?{_S}{{1,3}}(?:rue|avenue|boulevard|place|chemin|all[ée]e|impasse|quai|cours){_S}{{1,3}}(?:(?:de{_S}{{1,3}}la|des|du|de){_S}{{1,3}}|d['’])?\p{{L}}[\p{{L}}'’]+",
}
_ADDRESSES = {k: regex.compile(rf"(?<![\p{{L}}\p{{N}}_/.@:\-])(?:{p}){_TAIL}", regex.I) for k, p in _PLACES.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_PART = re.compile(r"[^\W\d_]+")
_INITIAL = regex.compile(r"(?<![\p{L}\p{N}'’@/.+\-])\p{Lu}\.(?=[\s​]|\p{Lu})")
_PARTICLE = frozenset("van von vom de der den des la le lo del della di da do das dos du zu zum zur ten ter te los las el al bin ibn bint ben abu af av ap st san y".split())
_GAP = regex.compile(r"[\s​]{1,4}")
_COMMA = regex.compile(r"[\s​]{0,2},[\s​]{1,4}")
_INITIAL_AT = regex.compile(r"\p{L}\.(?![\p{L}\p{N}]{2})|\p{Lu}(?![\p{L}\p{N}'’.\-])")
_POSSESSIVE = regex.compile(r"['’]s$", regex.I)

_CUES = {
    "call": "call text phone tel telephone teléfono telefon mobile reach number rückfragen joindre ring dial fax on-call operator whatsapp handy au unter nummer",
    "mail": "contact email mail mailto escalate write author avisar bitte send écrire reply-to trace via cc an à",
    "place": "to at livrer lieferung enviar returned lives deliver ship address an au wohnt vive adresse dirección visit",
    "who": "by with mit to from reporter par owner confirmó card signed off author über contact reviewed validé handed absprache according mr mrs ms dr prof herr frau mme",
    "machine": "ticket invoice sku part serial checksum build window relay reading sensor batch run note ref episode issue coordinates lane port trace version commit tracked under logged code order firmware rev lot model id hash sector line",
}
_CUE_OF = {w: c for c, ws in _CUES.items() for w in ws.split()}


_TOKEN = regex.compile(r"[\p{L}\-]+\.?|[^\s\p{L}]")
_NEXT = regex.compile(r"[\s\u200b]*(ext|x\d|durchwahl|poste)?([^\s]?)", regex.I)
_EMAIL_AT, _EMAIL_DOT = regex.compile(_AT + r"|\sat\s", regex.I), regex.compile(_DOT, regex.I)
_GLUED = re.compile(r"\.\w|[\[(]at")
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000"


def context(text: str, start: int, end: int) -> list[str]:
    """Features of what stands around a span."""
    left = text[max(0, start - 40) : start]
    before = _TOKEN.findall(left)[-3:]
    last = [b.lower().rstrip(".") for b in before]
    words_left = [b for b in last if b[:1].isalpha()]
    out = ["left:" + (_CUE_OF.get(words_left[-1], "other") if words_left else "none")]
    out += [f"near:{c}" for c in sorted({_CUE_OF[w] for w in words_left if w in _CUE_OF})]
    if words_left and words_left[-1] == "the":
        out.append("left:the")
    mark = left.rstrip()[-1:]
    out.append("mark:" + (mark if mark and not mark.isalnum() else "word" if mark else "begin"))
    right = text[end : end + 24]
    step = _NEXT.match(right)
    if step[1]:
        out.append("then:extension")
    if step[2]:
        out.append("then:" + ("word" if step[2].isalnum() else step[2]))
    return out


def _email_spans(text: str) -> Iterator[Span]:
    for m in _EMAIL.finditer(text):
        start, end = m.span()
        body = m.group().rstrip("-")
        end = start + len(body)
        sign = "＠" if "＠" in body else "@"
        local, _, domain = body.partition(sign) if sign in body else (_EMAIL_AT.split(body, maxsplit=1) + [""])[:1] + ["", body]
        f = ["email"]
        f.append("sign:" + ("at" if "@" in body else "word"))
        labels = [x for x in _EMAIL_DOT.split(domain.strip()) if x]
        f.append(f"labels:{min(len(labels), 3)}")
        last = labels[-1] if labels else ""
        f.append("top:" + ("letters" if last.isalpha() and len(last) > 1 else "version" if regex.fullmatch(r"v?\d+", last, regex.I) else "other"))
        if regex.match(r"v?\d", domain.strip(), regex.I):
            f.append("domain:version")
        if local.strip().lower() in ("git", "root", "admin", "deploy", "hg", "svn", "ubuntu", "pi"):
            f.append("local:login")
        after = text[end : end + 3]
        f.append("after:" + ("path" if regex.match(r":[~/\w]", after) else "slash" if after[:1] == "/" else "plain"))
        yield Span(start, end, "email", tuple(f))


def _phone_spans(text: str, numbers: bool = True, spoken: bool = True) -> Iterator[Span]:
    for plan, pattern in _PHONES.items():
        if not (spoken if plan == "spoken" else numbers):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            digits = sum(c.isdigit() for c in m.group())
            if plan != "spoken" and not 7 <= digits <= 15:
                continue
            body = m.group()
            f = ["phone", f"plan:{plan}", *(f"phone|{x}" for x in context(text, start, end))]
            if plan in ("nanp", "local"):
                f.append(f"{plan}:" + ("bare" if body.isdigit() else "grouped"))
            if body[0] == "(" or "(" in body:
                f.append("bracket")
            if body.startswith("+"):
                f.append("plus")
            if regex.match(r"(?:19|20)\d\d-\d\d-\d\d", body):
                f.append("date")
            if "," in text[end : end + 1] and text[end + 1 : end + 2].isdigit():
                f.append("number")
            yield Span(start, end, "phone", tuple(f))


def _id_spans(text: str) -> Iterator[Span]:
    for shape, pattern in _ID_SHAPES.items():
        for m in pattern.finditer(text):
            left = _QUOTES.sub("", text[max(0, m.start() - 56) : m.start()])
            label = _ID_LABEL.search(left)
            if not label:
                continue
            clear = label.start() == 0 or not left[label.start() - 1].isalnum()
            f = ["id", f"shape:{shape}", "label:clear" if clear else "label:inside", f"id|{context(text, m.start(), m.end())[0]}"]
            yield Span(m.start(), m.end(), "id_number", tuple(f))


def _address_spans(text: str) -> Iterator[Span]:
    for form, pattern in _ADDRESSES.items():
        for m in pattern.finditer(text, overlapped=form == "house"):
            start, end = m.span()
            body = m.group()
            f = ["address", f"form:{form}", *(f"address|{x}" for x in context(text, start, end))]
            f.append("town" if regex.search(r"[,\n]", body.rstrip(",")) else "no_town")
            names_in = regex.findall(r"\p{L}{4,}", body)
            f.append("case:" + ("upper" if body.isupper() else "lower" if body.islower() else "title" if names_in and names_in[0][0].isupper() else "mixed"))
            if form == "house" and regex.match(r"\d+\s+(?:\p{Ll}\w*\s+)", body):
                f.append("house:lower_word")
            yield Span(start, end, "address", tuple(f))


#: Function words of several languages: they begin no name, and are no family name unless in another case.
_STOP = frozenset(
    "san santa saint a an the and or but if when then than so as at by for from in into of off on onto out over per to up via with without do does did not no nor we i you he she it they our your his her its their my this that these those there here is are was were be been has have had will would "
    "can could may might must should shall all any each every few more most other some such only own same too very just also both between after before during while until since because what which who whom whose why how where now once again please "
    "der die das den dem des ein eine einer einem und oder aber wenn dann als am an auf aus bei bis durch für im in mit nach ohne seit über um unter vom von vor während zu zum zur wir ich sie er es ist sind war nicht kein keine dadurch bitte "
    "le la les l un une du des et ou mais si dans sur sous avec sans par pour nous vous il elle ils est sont depuis après avant pendant el los las una unos y o pero en con sin por para desde hasta se lo que es son no nosotros".split()
)
#: Words that end or begin names of firms, places, teams, products and machines.
_THINGS = frozenset(
    "academy agency airport arena association authority bank bay board bridge building bureau campus canyon cell center centre circle city club college committee company consortium corporation council county crew crossing department depot desk district dock edition engineering express falls farm ferry "
    "field forest foundation garage gate generation grid group guild hall hangar harbor harbour heights hill hospital hotel house inc industries institute international island junction lab laboratories laboratory labs lake library limited line llc ltd mall market mine mission mode model mountain museum network office operations "
    "park pass peak pier plant plaza point pond port portal press production products program programme project quay range region research reserve ridge river road robot robotics rover row school sciences sector sensor server service services shed ship society software solutions sprint square stadium station store storage street "
    "studio suite system systems team technologies technology terminal theatre tower town tunnel union university unit valley vault version view village wharf wing works yard zone machine waypoint gmbh new north south east west united royal golden cloud year insurance security licence license card passport number ag bus truck drone engine platform release server cluster mesa street avenue lane".split()
)
#: Words that say what a person does, after the name, and words that introduce one.
_DOES = frozenset(
    "asked asks said says wrote writes called calls left leaves will would has had was is reported reports confirmed confirms signed reviewed approved lives joined met sent wants went came thinks thought agreed answered moved works worked told steht hat sagt sagte war ist wird ayer hier dijo pidió a est dit".split()
)
_TITLE = frozenset("mr mrs ms miss mx dr prof professor sir dame herr frau fr hr mme mlle sr sra srta don doña madame monsieur señor señora".split())
_TWO_CAPITALS = regex.compile(r"\p{Lu}[\p{L}\p{M}'’\-]*[\p{L}\p{M}](?:[\s\u200b]{1,4}|[\s\u200b]{0,2},[\s\u200b]{1,4})\p{Lu}")


#: Vocabularies of public tokenizers, whose tokens say which words are common in running text.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def common_words(paths: tuple[str, ...] = VOCABULARIES) -> frozenset:
    """Lower-case words of three letters and more that are a token after a space, earlier in the vocabulary than with a capital."""
    out = set()
    for path in paths:
        with open(path, "rb") as f:
            tokens = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        for token, rank in tokens.items():
            if token[:1] == b" " and len(token) > 3:
                try:
                    word = token[1:].decode()
                except UnicodeDecodeError:
                    continue
                if word.isalpha() and word.islower() and rank < tokens.get(b" " + word.capitalize().encode(), 1 << 30):
                    out.add(word)
    return frozenset(out)


def _sort(word: str, names: Names) -> str:
    if len(word.rstrip(".")) == 1:
        return "initial"
    if names.is_given(word):
        return "known"
    low = word.lower()
    return "thing" if low in _THINGS else "cue" if low in _CUE_OF or low in _TITLE else "stop" if low in _STOP else "common" if low in common_words() else "unknown"


def _person_spans(text: str, names: Names, words: list[tuple[int, int, str]]) -> Iterator[Span]:
    at = {w[0]: k for k, w in enumerate(words)}
    ends = {w[1]: k for k, w in enumerate(words)}
    begins = [w[0] for w in words]
    sorts: dict[int, tuple[str, str]] = {}

    def about(k: int) -> tuple[str, str]:
        """(the word without a possessive, its sort)"""
        if k not in sorts:
            word = _POSSESSIVE.sub("", words[k][2])
            sorts[k] = word, _sort(word, names)
        return sorts[k]

    def after(end: int, pattern=_GAP) -> int | None:
        m = pattern.match(text, end)
        return m.end() if m else None

    def families(position: int | None, lower: bool) -> Iterator[tuple[int, int, bool]]:
        """(end, number of the word, whether a particle came first) of family names that begin at `position`."""
        particle = False
        while position is not None and position in at:
            k = at[position]
            s, e, w = words[k]
            word, sort = about(k)
            if len(word) > 1 and (w[0].isupper() or lower) and not (particle and sort == "stop"):
                yield s + len(word), k, particle
            if w.lower() not in _PARTICLE:
                return
            particle, position = True, after(e)

    def case(word: str) -> str:
        return "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower"

    def span(start: int, end: int, order: str, given: str, sort: str, k: int, particle: bool, more: int = 0) -> Span:
        family, its = about(k)
        its = "listed" if names.is_family(family) else its
        one, two = case(given.rstrip(".")), case(family)
        cases = two if sort == "initial" else one if one == two else "mixed"
        out = ["person", f"order:{order}", f"given:{sort}", f"family:{its}", f"{order}:{sort}:{its}", f"case:{sort}:{cases}", "short_family" if len(family) < 3 else "family"]
        if particle:
            out.append("particle")
        if more:
            out.append(f"more_families:{sort}")
        # What stands before: a word just before it, how it is written, and what it means.
        left = text[max(0, start - 12) : start]
        gap = len(left.rstrip(_BLANKS))
        before = ends.get(max(0, start - 12) + gap - (left[gap - 1 : gap] == "."))
        mark = left[gap - 1 : gap]
        if before is None or (mark == "." and len(words[before][2]) > 1 and words[before][2].lower() not in _TITLE):
            lead = f"mark:{mark or 'begin'}"
        else:
            low = words[before][2].lower()
            lead = "initial" if len(low) == 1 else "title" if low in _TITLE else "cue:" + _CUE_OF[low] if low in _CUE_OF else "thing" if low in _THINGS else "the" if low == "the" else "stop" if low in _STOP else "capital" if words[before][2][0].isupper() else "word"
        if "\n" in left[gap:]:
            lead = "line"
        nxt = after(end)
        follows = text[end : end + 1]
        if nxt in at:
            low = words[at[nxt]][2].lower()
            trail = "does" if low in _DOES else "thing" if low in _THINGS else "stop" if low in _STOP else "capital" if words[at[nxt]][2][0].isupper() else "word"
            if "\n" in text[end:nxt]:
                trail = "line"
        else:
            trail = "mark:" + (text[nxt : nxt + 1] if nxt else follows or "end")
        known = sort in ("known", "initial") or its == "listed"
        out += [f"lead:{lead}", f"trail:{trail}", f"lead:{lead}:{sort}", f"trail:{trail}:{sort}", f"lead:{lead}:{'known' if known else 'unknown'}:{order}"]
        # Capitals say little where the words around have them too.
        i, j = bisect_left(begins, start), bisect_left(begins, end)
        around = [w[2] for w in (*words[max(0, i - 4) : i], *words[j : j + 4]) if len(w[2]) > 2]
        if len(around) > 1:
            raised = "upper" if 2 * sum(w.isupper() for w in around) > len(around) else "title" if 3 * sum(w[0].isupper() for w in around) > 2 * len(around) else "lower"
            out += [f"around:{raised}:{cases}", f"around:{raised}:{sort}", f"around:{raised}:{sort}:{its}"]
        if text[max(0, start - 1) : start] in ("_", "@", "+", "/", ".", "#", "-") and start:
            out.append("joined")
        if text[end : end + 1] in ("@", "_", "+", "/") or _GLUED.match(text, end):
            out.append("joined")
        return Span(start, end, "person", tuple(out))

    for k, (s, e, w) in enumerate(words):
        if not w[0].isupper() and not names.in_lower(w[:-2] if w[-2:] in ("'s", "’s") else w):
            continue
        follower = words[k + 1][2] if k + 1 < len(words) else ""
        if not (follower[:1].isupper() or follower in _PARTICLE or names.is_given(_POSSESSIVE.sub("", w)) or names.in_lower(_POSSESSIVE.sub("", follower))):
            continue
        word, sort = about(k)
        if sort in ("stop", "initial"):
            continue
        # Given (initials) family (second family).
        position = after(e)
        for _ in range(3):
            for stop, f, particle in families(position, sort == "known"):
                yield span(s, stop, "given_family", word, sort, f, particle)
                second = at.get(after(words[f][1]))
                if second is not None and words[f][2] == about(f)[0] and words[second][2][0].isupper() and about(second)[1] in ("unknown", "known", "common"):
                    yield span(s, words[second][0] + len(about(second)[0]), "given_family", word, sort, f, particle, 1)
            m = _INITIAL_AT.match(text, position) if position is not None else None
            if not m:
                break
            position = after(m.end())
        # Family, given  and  family given.
        for order, here in (("family_comma_given", after(e, _COMMA)), ("family_given", after(e))):
            if here is None or word != w or len(word) < 3 and order == "family_comma_given":
                continue
            m = _INITIAL_AT.match(text, here)
            g = at.get(here)
            if m and order == "family_comma_given" and text[here].isupper():
                yield span(s, m.end(), order, m.group(), "initial", k, False)
            if g is None or (order == "family_given" and about(g)[1] != "known") or about(g)[1] in ("stop", "initial"):
                continue
            if not (words[g][2][0].isupper() or names.in_lower(about(g)[0])):
                continue
            stop = words[g][0] + len(about(g)[0])
            m = _INITIAL_AT.match(text, after(words[g][1]) or len(text)) if stop == words[g][1] else None
            yield span(s, m.end() if m else stop, order, about(g)[0], about(g)[1], k, False)
    for m in _INITIAL.finditer(text):
        position = after(m.end()) or m.end()
        for _ in range(3):
            for stop, f, particle in families(position, False):
                yield span(m.start(), stop, "given_family", m.group(), "initial", f, particle)
            more = _INITIAL_AT.match(text, position) if position is not None else None
            if not more:
                break
            position = after(more.end()) or more.end()


#: What each grammar can't do without: seven digits in a row but for separators, two spoken digits, a label, a word of streets.
_CLUSTER = re.compile(r"\d(?:[\s\u200b.()\-–‐‑/]{0,3}\d){6,}")
#: Clusters that no numbering plan takes: a date, and twelve digits or more without a separator, a plus or a double zero.
_NO_PHONE = re.compile(r"[12]\d\d\d-\d\d-\d\d|(?!00)\d{12,}")
_SPOKEN = frozenset("zero oh one two three four five six seven eight nine double triple".split())
_SPOKEN_PAIR = re.compile(rf"\b{_DIGIT}(?:[\s\-]+|,\s*){_DIGIT}\b")
_LABELS = frozenset("ni dni nie nif nir tin id".split())
_LONG_LABELS = ("ssn", "social", "nino", "national", "insee", "curit", "steuer", "tax", "itin", "curp", "passport", "reisepass", "pasaporte", "passeport", "licen", "führerschein", "fuhrerschein", "permis", "identit", "ausweis")
_STREET_WORDS = frozenset(
    "street st road rd lane ln avenue ave terrace gardens gdns court ct drive blvd boulevard close way square sq place pl crescent row walk hill mews park box postfach apartado postale bp calle plaza avenida avda av "
    "paseo camino rue chemin allée allee impasse quai cours".split()
)
_STREET_END = re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|ufer)[\s\u200b]{1,3}\d|\bc/|\bb\.?p\.?[\s\u200b]")
#: One of these is in every text that the pattern before can match.
_STREET_PARTS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "c/", "b.p", "bp")
_OBSCURED = re.compile(r"[\[({]\s?at\s?[\])}]|\sdot\s")


def spans(text: str, names: Names) -> list[Span]:
    """Every span that could be an item, with its features."""
    out: list[Span] = []
    lower = text.lower()
    low = set(_PART.findall(lower))
    if "@" in text or "＠" in text or _OBSCURED.search(lower):
        out += _email_spans(text)
    numbers = any(text[m.start() - 1 : m.start()] == "+" or not _NO_PHONE.fullmatch(m.group()) for m in _CLUSTER.finditer(text))
    spoken = len(_SPOKEN & low) > 1 and _SPOKEN_PAIR.search(lower) is not None
    if numbers or spoken:
        out += _phone_spans(text, numbers, spoken)
    if any(x in lower for x in _LONG_LABELS) or not low.isdisjoint(_LABELS):
        out += _id_spans(text)
    if not low.isdisjoint(_STREET_WORDS) or (any(x in lower for x in _STREET_PARTS) and _STREET_END.search(lower)):
        out += _address_spans(text)
    if names.hints(low) or _TWO_CAPITALS.search(text) or _INITIAL.search(text):
        out += _person_spans(text, names, [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)])
    return [s for s in out if s.end - s.start <= LONGEST]


#: Characters between two items, none a letter or digit, up to which they are neighbours.
NEAR = 6


def transition(text: str, a: Span, b: Span) -> str | None:
    """The feature of two items that follow each other with separators only, else none."""
    gap = text[a.end : b.start]
    if a.end > b.start or len(gap) > NEAR or any(c.isalnum() for c in gap):
        return None
    mark = next((c for c in gap if not c.isspace()), "line" if "\n" in gap else "space")
    return f"{a.kind}>{b.kind}:{mark}"


def neighbours(text: str, found: list[Span], weights: dict[str, float]) -> dict[int, list[tuple[int, float]]]:
    """For each span (by number, in the order of ends) the spans that may be its left neighbour, and the score of that."""
    out: dict[int, list[tuple[int, float]]] = {}
    by_end: dict[int, list[int]] = {}
    for k, s in enumerate(found):
        by_end.setdefault(s.end, []).append(k)
    for k, s in enumerate(found):
        for end in range(max(0, s.start - NEAR), s.start + 1):
            for j in by_end.get(end, ()):
                f = transition(text, found[j], s)
                if f:
                    out.setdefault(k, []).append((j, weights.get(f, 0.0)))
    return out


def best(found: list[Span], scores: list[float], near: dict[int, list[tuple[int, float]]] | None = None) -> list[Span]:
    """The spans of the best segmentation: no overlaps, highest sum of scores and of transitions between neighbours (`near`).

    Each state is the last item taken. What is not its neighbour is reached through the best state that ends early enough.
    """
    near = near or {}
    order = sorted(range(len(found)), key=lambda k: (found[k].end, found[k].start))
    ends = [found[k].end for k in order]
    total: dict[int, tuple[float, int]] = {}
    upto: list[tuple[float, int]] = []  # the best state among the first n of `order`
    for k in order:
        start = found[k].start
        value, back = 0.0, -1
        beside = dict(near.get(k, ()))
        at = bisect_right(ends, start)
        # States that may be neighbours are looked at one by one, as their transition may cost something.
        while at and ends[at - 1] >= start - NEAR:
            j = order[at - 1]
            if j in total:
                v = total[j][0] + beside.get(j, 0.0)
                if v > value:
                    value, back = v, j
            at -= 1
        if at and upto[at - 1][0] > value:
            value, back = upto[at - 1]
        total[k] = (value + scores[k], back)
        last = upto[-1] if upto else (0.0, -1)
        upto.append((total[k][0], k) if total[k][0] > last[0] else last)
    out, k = [], upto[-1][1] if upto else -1
    while k >= 0:
        out.append(found[k])
        k = total[k][1]
    return out[::-1]


def items(text: str, names: Names, weights: dict[str, float]) -> list[Span]:
    found = spans(text, names)
    if not found:
        return []
    scores = [sum(weights.get(f, 0.0) for f in s.features) for s in found]
    reach = weights.get("reach", 0.0)
    kept = [k for k, x in enumerate(scores) if x > -2 * reach]
    found = [found[k] for k in kept]
    return best(found, [scores[k] for k in kept], neighbours(text, found, weights))


@lru_cache(maxsize=1)
def trained() -> dict[str, float]:
    return json.loads(resources.files("tessaline.llm").joinpath("pii_weights.json").read_text())


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], names: Names | list[Names], epochs: int = 20, rate: float = 0.3, decay: float = 1e-4) -> dict[str, float]:
    """Weights that maximise the likelihood of the labelled segmentations: (text, [(start, end, kind)]).

    `names` is one lexicon, or several that are dealt to the rows in turn.
    """
    lattice = []
    for number, (text, gold) in enumerate(rows[:TRAIN_ROWS]):
        found = sorted(spans(text, names[number % len(names)] if isinstance(names, list) else names), key=lambda s: (s.end, s.start))
        if found:
            right = set()
            for start, end, kind in gold:
                same = [i for i, x in enumerate(found) if (x.start, x.kind) == (start, kind)]
                if same:
                    right.add(min(same, key=lambda i: abs(found[i].end - end)))
            links = {(j, k): f for k in range(len(found)) for j in range(k) if (f := transition(text, found[j], found[k]))}
            lattice.append((found, right, links))
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    order = np.random.default_rng(3)

    def step(f: str, g: float) -> None:
        seen[f] = seen.get(f, 0.0) + g * g
        w[f] = w.get(f, 0.0) + rate * g / math.sqrt(seen[f] + 1e-6) - decay * w.get(f, 0.0)

    for _ in range(epochs):
        for at in order.permutation(len(lattice)):
            found, gold, links = lattice[at]
            p, q = marginals(found, [sum(w.get(f, 0.0) for f in s.features) for s in found], {x: w.get(f, 0.0) for x, f in links.items()})
            ranked = sorted(gold)
            follow = set(zip(ranked, ranked[1:], strict=False))
            for i, s in enumerate(found):
                g = (i in gold) - p[i]
                if abs(g) >= 1e-4:
                    for f in s.features:
                        step(f, g)
            for x, f in links.items():
                g = (x in follow) - q[x]
                if abs(g) >= 1e-4:
                    step(f, g)
    out = {k: round(v, 3) for k, v in sorted(w.items()) if abs(v) >= 0.02}
    # How much the neighbours of a span can add to its score: one that lacks more is in no best segmentation.
    out["reach"] = max([0.0, *(v for k, v in out.items() if ">" in k)])
    return out


def marginals(found: list[Span], scores: list[float], links: dict[tuple[int, int], float]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """The probability of each span, and of each two neighbours, under the model: forward and backward sums over all segmentations."""
    n = len(found)
    lse = lambda xs: (top := max(xs)) + math.log(sum(math.exp(x - top) for x in xs))
    forward, backward = [0.0] * n, [0.0] * n
    for k in range(n):
        forward[k] = scores[k] + lse([0.0, *(forward[j] + links.get((j, k), 0.0) for j in range(k) if found[j].end <= found[k].start)])
    for k in range(n - 1, -1, -1):
        backward[k] = lse([0.0, *(scores[j] + links.get((k, j), 0.0) + backward[j] for j in range(k + 1, n) if found[k].end <= found[j].start)])
    z = lse([0.0, *forward])
    single = [math.exp(min(0.0, forward[k] + backward[k] - z)) for k in range(n)]
    pair = {(j, k): math.exp(min(0.0, forward[j] + v + scores[k] + backward[k] - z)) for (j, k), v in links.items()}
    return single, pair


def redact(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def lexicon(spark: SparkSession, entities: DataFrame) -> Names | DataFrame:
    """What `entities` (entity_name, label) say of names: carried if it is small, else a cut table (word, role) that is joined."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for n, k in zip(b.entity_name, b.label, strict=True) for x in name_words(n, k)], columns=["word", "role"])

    known = cut(entities.select("entity_name", "label").where("entity_name is not null").mapInPandas(split, "word string, role string").distinct())
    if known.count() > CARRIED_WORDS:
        return known
    rows = known.collect()
    return Names([r.word for r in rows if r.role == "given"], [r.word for r in rows if r.role == "family"])


def _texts(rows: DataFrame, id_col: str, text_col: str, names: Names | DataFrame) -> DataFrame:
    """(row_id, text), and with a joined lexicon (given, families): the words of it that each text has."""
    small = rows.select(F.col(id_col).cast("string").alias("row_id"), F.col(text_col).alias("text"))
    if isinstance(names, Names):
        return spread(small)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {(n, f) for n, t in zip(b.n, b.text, strict=True) if t for w in set(_PART.findall(t)) for f in (fold(w), fold(w, True))}
            yield pd.DataFrame(sorted(out), columns=["n", "word"])

    small = cut(small.withColumn("n", F.monotonically_increasing_id()))
    met = small.select("n", "text").mapInPandas(split, "n long, word string").join(names, "word")
    of = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("word")))
    return small.join(met.groupBy("n").agg(of("given").alias("given"), of("family").alias("families")), "n", "left").drop("n")


def _each(rows: DataFrame, names: Names | DataFrame, weights: dict[str, float], make, schema: str) -> DataFrame:
    """`make` (row id, text, items of it) over batches of `_texts`."""
    carried = names if isinstance(names, Names) else None

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            joined = () if carried else (b.given, b.families)
            for i, t, *its in zip(b.row_id, b.text, *joined, strict=True):
                known = carried or Names(*(() if x is None else x for x in its))
                out += make(i, t, items(t, known, weights) if t else [])
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return rows.mapInPandas(find, schema)


def annotate(rows: DataFrame, id_col: str, text_col: str, names: Names | DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(row_id, redacted, items) of every row; items is an array of (kind, start_pos, end_pos)."""
    make = lambda i, t, found: [(i, redact(t, found) if t else t, [(s.kind, s.start, s.end) for s in found])]
    schema = "row_id string, redacted string, items array<struct<kind:string,start_pos:bigint,end_pos:bigint>>"
    return _each(_texts(rows, id_col, text_col, names), names, trained() if weights is None else weights, make, schema)


def found_items(rows: DataFrame, id_col: str, text_col: str, names: Names | DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(row_id, kind, start_pos), one row for each item; only what is found leaves the Python worker."""
    make = lambda i, t, found: [(i, s.kind, s.start) for s in found]
    texts = _texts(rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, names)
    return _each(texts, names, trained() if weights is None else weights, make, "row_id string, kind string, start_pos long")
