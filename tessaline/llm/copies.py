"""Duplicates hidden by formatting: records that are the same but for white space, case, punctuation or field order.

Each record gets a canonical form, computed once. The canonical records are range-partitioned by (form, id) and sorted
within their partitions (Spark's external sort), and every partition is scanned once: adjacent records with the same
full form are a run, whose first id represents it. As the id is part of the range key, a form that a third of all
records share is spread over many partitions; the runs it is broken into are stitched by the two edge runs of
each partition, a table as small as the number of partitions. Copies are counted exactly.

Canonical form. Invisible characters (Unicode Cf, Cc) are dropped, letters are case-folded, white space, punctuation and
symbols are dropped, except a point or comma between two digits and a minus directly before a digit that doesn't follow
a letter or digit. A list of named fields (a JSON object, or `key=value` and `key: value` lists) becomes its sorted
(key, value) pairs, each in this form; arrays and objects inside keep their structure. What begins like an object but isn't
covered by its pairs is prose.

Defined results: a null content or null id takes no part. Empty and blank contents are all the same record. Other
columns don't matter, whatever their names. Texts of any length are compared whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.runtime import cut

_INVISIBLE = regex.compile(r"[\p{Cf}ᅟᅠㅤ͏]+")
_DASH = r"\-‐‑‒–—−－﹣"
#: What stays of a text: letters, marks, numbers; a point or comma between digits; a minus before a number.
_KEEP = regex.compile(rf"[\p{{L}}\p{{M}}\p{{N}}]+|(?<=\p{{Nd}})[.,](?=\p{{Nd}})|(?<![\p{{L}}\p{{N}}\p{{M}}])[{_DASH}](?=\p{{Nd}})")
_DASHES = regex.compile(rf"[{_DASH}]")
_KEY = r"[\p{L}_][\p{L}\p{N}_.\-]*"
_JSON_PAIR = regex.compile(r'"(?P<k>(?:[^"\\]|\\.)*)"\s*:\s*(?:"(?P<v>(?:[^"\\]|\\.)*)"|(?P<n>[^",{}\[\]]+))\s*(?:,|\}|$)')
_FIELD = regex.compile(rf"[\s\"'{{]*(?P<k>{_KEY})[\"']?\s*(?:=>|->|:=|[:=])\s*(?P<v>.*?)[\s\"'}}]*", regex.S)
_ENDS = " \t\r\n;,.!?…"


def plain(text: str) -> str:
    """`text` without case, white space, punctuation and symbols, but for those that belong to numbers."""
    text = _INVISIBLE.sub("", text).casefold()
    return _DASHES.sub("-", "".join(_KEEP.findall(text)))


def scalar(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def valued(value: object) -> str:
    """The form of a field's value: objects (tuples of pairs) and arrays in brackets, which `plain` never leaves."""
    if isinstance(value, tuple):
        return "{" + "\x1d".join(sorted(f"{plain(k)}\x1c{valued(v)}" for k, v in value)) + "}"
    if isinstance(value, list):
        return "[" + "\x1d".join(valued(v) for v in value) + "]"
    return plain(scalar(value))


def fields(text: str) -> list[tuple[str, object]] | None:
    """The named fields of a record that is a list of them, in order; None for prose."""
    text = _INVISIBLE.sub("", text).strip().strip(_ENDS)
    if text.startswith("{"):
        try:
            whole = json.loads(text, object_pairs_hook=tuple, parse_int=str, parse_float=str, parse_constant=str, strict=False)
        except (ValueError, RecursionError):
            whole = ()
        if whole:
            return list(whole)
        pairs = [(m["k"], m["v"] if m["v"] is not None else m["n"].strip()) for m in _JSON_PAIR.finditer(text)]
        if pairs:
            if _JSON_PAIR.sub("", text).strip(" \t\r\n{},"):
                return None
            try:
                pairs = [(k, json.loads(f'"{v}"')) for k, v in pairs]
            except ValueError:
                pass
            return pairs
    for cut_at in ("\n", "|", ";", ","):
        parts = [p for p in text.replace("\r", "\n").split(cut_at) if p.strip(_ENDS + "|")]
        if len(parts) < 2:
            continue
        found = [_FIELD.fullmatch(p) for p in parts]
        if all(found):
            return [(m["k"], m["v"]) for m in found]
    return None


def canonical(text: str) -> str:
    named = fields(text)
    if named is None:
        return "t" + plain(text)
    return "f" + "\x1f".join(sorted(f"{plain(k)}\x1e{valued(v)}" for k, v in named))


def runs(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, first_id, copies): each record with the smallest id of its group, and how many records the group has."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(canonical)

    keyed = cut(
        records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
            F.col(id_col).cast("string").alias("id"), form(F.col(text_col)).alias("form")
        )
    )
    ranged = keyed.repartitionByRange("form", "id").sortWithinPartitions("form", "id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members with the first id of their run here. Of the first and the last run, the row that begins it has the form."""
        me = TaskContext.get().partitionId()
        run, head, form_now = -1, None, None
        for b in batches:
            if b.empty:
                continue
            forms, ids = b["form"], b["id"]
            starts = forms.ne(forms.shift()).to_numpy(copy=True)
            starts[0] = form_now is None or forms.iloc[0] != form_now
            numbers = run + starts.cumsum()
            firsts = ids.where(pd.Series(starts, index=ids.index)).ffill()
            if not starts[0]:
                firsts = firsts.fillna(head)
            yield pd.DataFrame({
                "id": ids, "local": firsts, "part": me, "run": numbers, "form": forms.where(pd.Series(starts & (numbers == 0), index=ids.index)),
            })
            run, head, form_now = int(numbers[-1]), firsts.iloc[-1], forms.iloc[-1]
        if form_now is not None:
            yield pd.DataFrame({"id": [None], "local": [head], "part": [me], "run": [run], "form": [form_now]})

    schema = "id string, local string, part int, run long, form string"
    scanned = cut(ranged.mapInPandas(scan, schema))
    # The edges: of each partition its first run, and (with a null id) its last. Runs that go on are given their true head.
    edges = scanned.where("form is not null").select("part", "id", "local", "run", "form").collect()
    first = {e.part: e for e in edges if e.id is not None}
    last = {e.part: e for e in edges if e.id is None}
    heads: list[tuple[int, str]] = []
    open_form, open_head = None, None
    for part in sorted(first):
        if first[part].form == open_form:
            heads.append((part, open_head))
        if last[part].run > 0 or first[part].form != open_form:
            open_head = last[part].local
        open_form = last[part].form
    stitched = records.sparkSession.createDataFrame(heads, "at int, head string")
    members = scanned.where("id is not null").join(F.broadcast(stitched), (F.col("part") == F.col("at")) & (F.col("run") == 0), "left")
    return members.select("id", F.coalesce("head", "local").alias("first_id"))


def copies(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first_id, copies): one representative of each group and its exact number of records."""
    return runs(records, id_col, text_col).groupBy("first_id").agg(F.count("*").alias("copies"))
