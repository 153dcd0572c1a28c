"""Variant spellings of names: each spelling is linked to the entity it refers to, or to none.

Names are folded (case, accents, digits that look like letters, punctuation, titles, possessives) and written without spaces. Every entity has a
bounded set of forms: given and family name in either order, with nicknames, initials or a short given name; for organisations the
full name, the name without its legal form, the inverted name and the acronym. Words of a typed organisation that abbreviate a word
of the entities' own vocabulary are expanded.

Linking is a pigeonhole segment join. A form that may be k edits away (insert, delete, replace, or swap of neighbours) is cut into
k + 1 segments. If no swap crosses a border, one segment is intact in the typed name, shifted by at most k. A swap that does
touches two, but by counting, some segment is then touched by nothing but one such swap; so each place is looked up as it stands and, where a swap
is left, with its outer letter taken from beyond the border. The segments are an inverted index, joined by (form length, number, segment), and
banded edit distance verifies what meets. k is 0, 1 or 2 by the length of the form.

Everything about entities is a table: forms and segments are made where the entities lie, the vocabulary is joined to the typed words, and a table is
broadcast only if its counted rows are few. The result is the same for any number of entities. Distinct spellings are
linked once, however often they occur, so a name that a third of the records hold is one row until the last join.

Of the verified entities the one with the fewest edits and plainest form wins; a spelling that fits two entities equally well refers to neither.
A typed person who has another known given name than the entity is somebody else; so is one with a slip that recurs (`OTHERS`, `SHARE`): slips
are rare and differ, names recur.

Defined results: null and blank spellings refer to nothing; repeated spellings in a record give one row; an empty entity table gives
none. Texts of any length are folded whole; only lengths that some form can reach are looked up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.given_names import NICKNAMES
from tessaline.runtime import cut, parallelism

#: Usual abbreviations that are no prefix of their word; prefixes and words without vowels are found by rule. General usage in names of firms and institutions.
SHORT = {
    "acad": "academy", "ag": "aktiengesellschaft", "agcy": "agency", "amer": "american", "assn": "association", "assoc": "association", "auth": "authority", "bros": "brothers", "bus": "business", "chem": "chemical",
    "cmte": "committee", "cncl": "council", "co": "company", "coll": "college", "comm": "communications", "coop": "cooperative", "corp": "corporation", "ctr": "center", "dept": "department", "dev": "development",
    "dist": "distribution", "ed": "education", "elec": "electric", "eng": "engineering", "engr": "engineering", "ent": "enterprises", "env": "environmental", "fdn": "foundation", "fed": "federal", "fin": "financial", "fnd": "foundation",
    "govt": "government", "grp": "group", "hldgs": "holdings", "hosp": "hospital", "inc": "incorporated", "ind": "industries", "ins": "insurance", "inst": "institute", "int": "international", "intl": "international",
    "inv": "investment", "labs": "laboratories", "lib": "library", "log": "logistics", "logist": "logistics", "ltd": "limited", "mach": "machinery", "med": "medical", "mem": "memory", "mfg": "manufacturing", "mgmt": "management",
    "mktg": "marketing", "mtl": "materials", "mus": "museum", "natl": "national", "pharm": "pharmaceuticals", "proc": "processing", "prod": "products", "rd": "research", "robots": "robotics", "rsrch": "research", "sch": "school", "sci": "sciences",
    "soc": "society", "surv": "survey", "svc": "service", "svcs": "services", "svy": "survey", "sys": "systems", "tech": "technologies", "telecom": "telecommunications", "trans": "transport", "univ": "university",
}
TITLES = frozenset("dr mr mrs ms miss mx prof professor sir dame herr frau fr hr mme mlle sr sra srta dipl ing phd md".split())
_ARTICLE = regex.compile(r"^\W*the(?:[\s_\-]+|\.(?=\p{L}))", regex.I)
_LOOKS = str.maketrans("0135$@", "olessa")
_DIGRAPHS = {"ö": "oe", "ä": "ae", "ü": "ue", "ø": "oe", "å": "aa", "æ": "ae", "œ": "oe", "ß": "ss"}
_PLAIN = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ı": "i"}
_POSSESSIVE = regex.compile(r"['’`]s?$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}$@]+(?:['’`][\p{L}\p{M}]+)*")

#: Least lengths of a whole name for one edit, of any form for one, and for two; a shorter one must be met exactly.
WHOLE_EDIT, ONE_EDIT, TWO_EDITS = 5, 7, 11
#: Rows up to which a table of forms, segments or words is broadcast (some 40 MB); a larger one is shuffled.
BROADCAST_ROWS = 400_000
#: A slip is taken for another person's name if so many records have it, and so large a part of those that have the entity's own.
OTHERS, SHARE = 5, 0.25


def fold(word: str, digraphs: bool = False) -> str:
    word = unicodedata.normalize("NFC", word).lower()
    if digraphs:
        word = "".join(_DIGRAPHS.get(c, c) for c in word)
    word = unicodedata.normalize("NFKD", word)
    word = "".join(_PLAIN.get(c, c) for c in word if not unicodedata.combining(c))
    return word.translate(_LOOKS)


def words(name: str, digraphs: bool = False) -> list[str]:
    name = _ARTICLE.sub("", unicodedata.normalize("NFKC", name))
    found = [_POSSESSIVE.sub("", w) for w in _WORD.findall(_POSSESSIVE.sub("", name.strip().rstrip("?!.,;: ")).replace("’", "'"))]
    return [fold(w.replace("'", ""), digraphs) for w in found if w]


def skeleton(word: str) -> str:
    return word[:1] + regex.sub("[aeiou]", "", word[1:])


def edits(length: int, cost: int = 0) -> int:
    """How many edits a form of a length and cost (0: a whole name) may be away."""
    return 0 if length < (ONE_EDIT if cost else WHOLE_EDIT) else 1 if length < TWO_EDITS else 2


def person_forms(name: str, nicknames: dict[str, str]) -> dict[tuple[str, str, str], int]:
    """(form, prefix, suffix) -> cost of its kind: 0 the whole name, then shortened ones. A shortened given name is too
    short to be typed wrongly and still be told from others, so it must be met exactly, as the prefix or suffix."""
    out: dict[tuple[str, str, str], int] = {}

    def add(first: str, second: str, cost: int, exact: int = -1) -> None:
        form = (first + second, first if exact == 0 else "", second if exact == 1 else "")
        if form[0] and cost < out.get(form, 99):
            out[form] = cost

    for digraphs in (False, True):
        parts = words(name, digraphs)
        if len(parts) < 2:
            add("".join(parts), "", 0)
            continue
        given, family = parts[0], "".join(parts[1:])
        add(given, family, 0)
        add(family, given, 0)
        short = [(n, 1) for n in nicknames.get(fold(name.split()[0]), "").split()]
        for g, cost in [*short, (given[:3], 2), (given[:4], 2), (given[0], 3)]:
            if g != given:
                # A nickname is long enough for a slip from four letters on.
                loose = cost == 1 and len(g) >= 4
                add(g, family, cost, -1 if loose else 0)
                add(family, g, cost, -1 if loose else 1)
        if len(parts) == 3:
            for part in parts[1:]:
                add(given, part, 2)
                add(part, given, 2)
    return out


def organisation_forms(name: str) -> dict[tuple[str, str, str], int]:
    out: dict[tuple[str, str, str], int] = {}

    def add(form: str, cost: int) -> None:
        if form and cost < out.get((form, "", ""), 99):
            out[form, "", ""] = cost

    for digraphs in (False, True):
        parts = [w for w in words(name, digraphs) if w != "and"]
        add("".join(parts), 0)
        add("".join(parts[1:] + parts[:1]), 0)
        if len(parts) > 2:
            add("".join(parts[:-1]), 1)
            add("".join(parts[1:-1] + parts[:1]), 2)
            add("".join(w[0] for w in parts), 3)
            if "and" in words(name):
                add("".join(w[0] for w in words(name)), 3)
    return out


def bare(parts: list[str]) -> list[str]:
    rest = [w for w in parts if w not in TITLES]
    # Before a single word a title is a short given name: "Ing." is an engineer or Ingrid.
    return rest if len(rest) > 1 or len(parts) == 1 else parts


def keys(typed: list[str], full: dict[str, str]) -> dict[str, int]:
    """The keys of typed words (without titles) -> what was done to them: 0 nothing or abbreviations expanded, 1 middle initials left out."""
    if not typed:
        return {}
    out = {"".join(typed): 0}
    plain = [w for w in typed if w != "and"]
    out.setdefault("".join(plain), 0)
    out.setdefault("".join(full.get(w, w) for w in plain), 0)
    if len(typed) >= 3:
        longer = [w for w in typed if len(w) > 1]
        if len(longer) >= 2:
            out.setdefault("".join(longer), 1)
    return {k: v for k, v in out.items() if k}


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, replacement or swap parts two words."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


def borders(length: int) -> list[int]:
    """The borders of the k + 1 even segments of a form of `length`."""
    n = edits(length) + 1
    return [round(i * length / n) for i in range(n + 1)]


def segments(form: str) -> list[tuple[int, int, str]]:
    """(number, start, text) of the segments of a form."""
    at = borders(len(form))
    return [(i, at[i], form[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def probes(key: str, lengths: set[int]) -> Iterator[tuple[int, int, str]]:
    """(form length, segment number, substring) for every place where a segment of a form within reach can stand in `key`."""
    for length in range(len(key) - 2, len(key) + 3):
        k = edits(length) if length > 0 else 0
        apart = len(key) - length
        if length not in lengths or abs(apart) > k:
            continue
        at = borders(length)
        for i in range(k + 1):
            seen = set()
            for shift in range(-k, k + 1):
                start, stop, left = at[i] + shift, at[i + 1] + shift, k - abs(shift) - abs(apart - shift)
                if left < 0 or start < 0 or stop > len(key):
                    continue
                seen.add(key[start:stop])
                if left and i < k and stop < len(key):
                    seen.add(key[start : stop - 1] + key[stop])
                if left and i and start:
                    seen.add(key[start - 1] + key[start + 1 : stop])
            for piece in seen:
                yield length, i, piece


def distances(left: list[str], right: list[str], k: int = 2) -> np.ndarray:
    """Edit distance with swaps of pairs of strings, banded at k; above k it is k + 1. All pairs advance together."""
    m = len(left)
    if not m:
        return np.zeros(0, int)
    a = _matrix(left)
    b = _matrix(right)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    far = k + 1
    width = 2 * k + 1
    # Band of row i: columns i - k .. i + k.
    prev2 = np.full((m, width), far, np.int8)
    prev = np.full((m, width), far, np.int8)
    for d in range(k, width):
        prev[:, d] = d - k
    result = np.where((la == 0) & (lb <= k), lb, far)
    rows = np.arange(m)
    for i in range(1, a.shape[1] + 1):
        now = np.full((m, width), far, np.int8)
        ca = a[:, i - 1]
        pa = a[:, i - 2] if i > 1 else None
        for d in range(width):
            j = i - k + d
            if j < 0 or j > b.shape[1]:
                continue
            if j == 0:
                now[:, d] = min(i, far)
                continue
            cb = b[:, j - 1]
            best = prev[:, d] + (ca != cb)
            if d + 1 < width:
                best = np.minimum(best, prev[:, d + 1] + 1)
            if d:
                best = np.minimum(best, now[:, d - 1] + 1)
            if pa is not None and j > 1:
                swap = (ca == b[:, j - 2]) & (pa == cb)
                best = np.where(swap, np.minimum(best, prev2[:, d] + 1), best)
            now[:, d] = np.minimum(best, far)
        prev2, prev = prev, now
        done = la == i
        if done.any():
            d = lb - i + k
            inside = done & (d >= 0) & (d < width)
            result[inside] = now[rows[inside], d[inside]]
    return np.minimum(result, far).astype(int)


def _matrix(strings: list[str]) -> np.ndarray:
    width = max(map(len, strings), default=0) or 1
    joined = "".join(s.ljust(width, "\0") for s in strings)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(strings), width)


def _small(table: DataFrame) -> DataFrame:
    """A cut table, marked for broadcast if its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _map(rows: DataFrame, function, schema: str) -> DataFrame:
    """`function` (row -> tuples of `schema`) over all rows, in batches."""
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for row in b.itertuples(index=False, name=None) for x in function(*row)], columns=columns)

    return rows.mapInPandas(run, schema)


def variants(word: str) -> set[str]:
    """The word and what is left after one deletion: words one edit apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def expansions(typed: DataFrame, vocabulary: DataFrame, given: DataFrame, mark=lambda t: t) -> DataFrame:
    """(word, full) of each of the `typed` words that abbreviates one word of the organisations' `vocabulary`, all by joins on words.

    `mark` is put on the tables that come of the vocabulary, to broadcast them where it is small.
    In this order: a usual abbreviation, the beginning of just one word, a slip in a usual abbreviation, the consonants of just one word.
    """
    spark = typed.sparkSession
    usual = spark.createDataFrame(list(SHORT.items()), "short string, full string")
    known = F.broadcast(usual.join(vocabulary.withColumnRenamed("word", "full"), "full"))
    fresh = cut(typed.where(F.length("word") >= 2).join(mark(vocabulary), "word", "left_anti"))
    direct = fresh.join(known, F.col("word") == F.col("short")).select("word", "full", F.lit(0).alias("way"))
    longer = cut(fresh.where(F.length("word") >= 3).join(mark(given), "word", "left_anti"))
    prefixes = vocabulary.select(F.col("word").alias("full"), F.explode(F.sequence(F.lit(3), F.length("word") - 1)).alias("n")).where(F.col("n") >= 3)
    alone = prefixes.groupBy(F.expr("left(full, n)").alias("word")).agg(F.min("full").alias("full"), F.count("*").alias("c")).where("c = 1")
    begins = longer.join(mark(alone), "word").select("word", "full", F.lit(1).alias("way"))
    lapses = _map(longer.where(F.length("word") >= 4), lambda w: [(w, s) for s in SHORT if len(s) >= 4 and one_edit(w, s)], "word string, short string")
    lapses = cut(lapses.join(known, "short").groupBy("word").agg(F.min("full").alias("full"), F.countDistinct("full").alias("c")).where("c = 1"))
    cuts = lambda t: _map(t, lambda w: [(w, v) for v in variants(w)], "word string, variant string")
    beside = cuts(lapses.select("word")).join(mark(cuts(vocabulary).withColumnRenamed("word", "full")), "variant")
    beside = _map(beside.select("word", "full").distinct(), lambda w, v: [(w,)] if one_edit(w, v) else [], "word string").distinct()
    slips = lapses.join(mark(beside), "word", "left_anti").select("word", "full", F.lit(2).alias("way"))
    bones = lambda c: F.concat(F.left(c, F.lit(1)), F.regexp_replace(F.expr(f"substring({c}, 2)"), "[aeiou]", ""))
    framed = vocabulary.select(F.col("word").alias("full"), bones("word").alias("frame"))
    whole = longer.join(mark(framed), F.col("word") == F.col("frame")).select("word", "full")
    part = longer.withColumn("frame", bones("word")).join(mark(framed), "frame").where(F.length("word") < F.length("full") - 2).select("word", "full")
    bony = whole.union(part).groupBy("word").agg(F.min("full").alias("full"), F.countDistinct("full").alias("c")).where("c = 1").select("word", "full", F.lit(3).alias("way"))
    every = direct.unionByName(begins).unionByName(slips).unionByName(bony)
    return every.groupBy("word").agg(F.min_by("full", "way").alias("full"))


def link(mentions: DataFrame, entities: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(spelling, uuid) of each spelling of `mentions` (any columns, with `spelling`) that refers to an entity.

    `entities` has (uuid, entity_name, label), label PERSON or ORGANIZATION.
    """
    spark, nick = mentions.sparkSession, NICKNAMES | (nicknames or {})
    wide = max(2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    entities = entities.select("uuid", "entity_name", "label").where("uuid is not null and entity_name is not null")

    # What the entities say: their forms, and the words of their organisations and given names.
    def forms_of(uuid: str, name: str, label: str) -> list[tuple]:
        made = organisation_forms(name) if label == "ORGANIZATION" else person_forms(name, nick)
        return [(uuid, name, label, *form, len(form[0]), cost, " ".join(sorted(words(name)))) for form, cost in made.items()]

    def words_of(name: str, label: str) -> list[tuple]:
        parts = words(name)
        return [(w, True) for w in parts[1:] if w] if label == "ORGANIZATION" else [(parts[0], False)] if len(parts) > 1 else []

    forms = _map(entities, forms_of, "uuid string, entity_name string, label string, form string, prefix string, suffix string, length int, kind int, own_key string")
    forms = cut(forms.withColumn("f", F.monotonically_increasing_id()))
    lengths = {r.length for r in forms.select("length").distinct().collect()}
    vocabulary = cut(_map(entities.select("entity_name", "label"), words_of, "word string, firm boolean").distinct())
    given = vocabulary.where("not firm").select("word")
    # A word gives a row for each of its beginnings and deletions, some sixteen.
    mark = F.broadcast if vocabulary.count() * 16 <= BROADCAST_ROWS else lambda t: t

    # What is typed: distinct spellings, their words, and what is known of these words.
    spellings = mentions.where(F.col("spelling").isNotNull()).groupBy("spelling").agg(F.count("*").alias("times"))
    # Few bytes, much work a row: adaptive execution would put them into one partition.
    typed = _map(spellings.repartition(wide, "spelling"), lambda s, n: [(s, n, bare(words(s)))], "spelling string, times long, typed array<string>")
    typed = cut(typed.withColumn("key", F.array_join(F.array_sort("typed"), " ")))
    met = cut(typed.select(F.explode("typed").alias("word")).distinct())
    full = expansions(met, vocabulary.where("firm").select("word"), given, mark)
    named = met.join(mark(given), "word", "left_semi")
    known = full.select("word", "full", F.lit(False).alias("is_given")).unionByName(named.select("word", F.lit(None).cast("string").alias("full"), F.lit(True).alias("is_given")))
    known = cut(known.groupBy("word").agg(F.max("full").alias("full"), F.bool_or("is_given").alias("is_given")))
    noted = typed.select("spelling", F.explode(F.array_distinct("typed")).alias("word")).join(_small(known), "word")
    noted = noted.groupBy("spelling").agg(F.collect_list(F.struct("word", "full", "is_given")).alias("known"))
    about = typed.select("spelling", "typed", "key").join(noted, "spelling", "left").repartition(wide)

    def probe(spelling: str, parts, key: str, notes) -> Iterator[tuple]:
        notes = [] if notes is None else list(notes)
        names = " ".join(n["word"] for n in notes if n["is_given"])
        for k, cost in keys(list(parts), {n["word"]: n["full"] for n in notes if n["full"]}).items():
            for p in probes(k, lengths):
                yield (spelling, key, names, k, cost, *p)

    looked_up = _map(about, probe, "spelling string, key string, names string, typed string, cost int, length int, segment int, piece string")
    index = _map(forms.select("f", "form"), lambda f, form: [(f, len(form), i, piece) for i, _, piece in segments(form)], "f long, length int, segment int, piece string")
    met = looked_up.join(_small(cut(index)), ["length", "segment", "piece"]).select("spelling", "key", "names", "typed", "cost", "f")
    pairs = met.join(_small(forms), "f")
    schema = "spelling string, uuid string, entity_name string, cost int, edits int, suspect boolean, key string, own_key string"
    found = cut(pairs.drop("f", "length").mapInPandas(verify, schema).distinct())
    # How often a suspicious name and the entity it resembles are met, as written without accents and order.
    asked = found.where("suspect").select("key").union(found.where("suspect").select(F.col("own_key").alias("key"))).distinct()
    counted = cut(typed.join(asked, "key", "left_semi").groupBy("key").agg(F.sum("times").alias("n")))
    judged = (
        found.join(counted.withColumnRenamed("n", "n_key"), "key", "left")
        .join(counted.select(F.col("key").alias("own_key"), F.col("n").alias("n_own")), "own_key", "left")
        .where(~(F.col("suspect") & (F.coalesce("n_key", F.lit(0)) >= OTHERS) & (F.coalesce("n_key", F.lit(0)) >= SHARE * F.coalesce("n_own", F.lit(0)))))
    )
    per_entity = judged.groupBy("spelling", "uuid").agg(F.min(F.struct("cost", "edits")).alias("best"), F.first("entity_name").alias("entity_name"))
    level = per_entity.groupBy("spelling", "best").agg(F.count("*").alias("rivals"), F.min(F.struct("uuid", "entity_name")).alias("x"))
    first = level.groupBy("spelling").agg(F.min(F.struct("best", "rivals", "x")).alias("c")).where("c.rivals = 1")
    return first.where(F.col("c.x.entity_name") != F.col("spelling")).select("spelling", F.col("c.x.uuid").alias("uuid"))


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of a typed name and a form that are within the form's edits, with what speaks against them."""
    columns = ["spelling", "uuid", "entity_name", "cost", "edits", "suspect", "key", "own_key"]
    for b in batches:
        b = b.drop_duplicates(["spelling", "typed", "uuid", "form", "prefix", "suffix"])
        out = []
        if len(b):
            t, typed = pd.factorize(b.typed)
            f, form = pd.factorize(b.form)
            limit = np.array([edits(n, c) for n, c in zip(b.form.str.len(), b.kind, strict=True)])
            near = np.abs(_histogram(list(typed))[t] - _histogram(list(form))[f]).sum(1) <= 2 * limit
            b, t, f, limit = b[near], t[near], f[near], limit[near]
            pair, back = np.unique(t.astype(np.int64) * len(form) + f, return_inverse=True)
            d = distances([typed[p // len(form)] for p in pair], [form[p % len(form)] for p in pair])[back] if len(pair) else np.zeros(0, int)
            for row, k in zip(b[d <= limit].itertuples(index=False), d[d <= limit].tolist(), strict=True):
                if not (row.typed.startswith(row.prefix) and row.typed.endswith(row.suffix)):
                    continue
                if row.label == "PERSON" and k:
                    own = set(words(row.entity_name) + words(row.entity_name, True))
                    if any(len(w) > 1 and w not in own for w in row.names.split()):
                        continue
                suspect = row.label == "PERSON" and k > 0
                out.append((row.spelling, row.uuid, row.entity_name, int(2 * k + row.kind + row.cost), int(k), suspect, row.key, row.own_key))
        yield pd.DataFrame(out, columns=columns)


def _histogram(strings: list[str]) -> np.ndarray:
    out = np.zeros((len(strings), 32), np.int16)
    if strings:
        m = _matrix(strings)
        rows, at = np.nonzero(m)
        np.add.at(out, (rows, m[rows, at] % 32), 1)
    return out
