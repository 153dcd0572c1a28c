"""Delimited lines: valid ones become typed rows, the others keep every reason for which they failed.

The cells of a line are exploded to (row, column, value), a rule table is joined on the column, each rule's
validation is evaluated on its value, the errors are aggregated per row and reason, and clean rows are what is left
after an anti-join with them. All of it is built-in functions, so nothing leaves the JVM and the only shuffle is that
of the few rows that failed (the anti-join).

Defined results: a null line, or an empty one, has one column or none and fails with `column_count`. A null file name,
or one of another ending, is read as comma-delimited. Repeated lines stay, each with its own line id. Extra columns of the input,
whatever their names, are ignored by `errors` and kept by `split_rows` unless they clash with the typed columns,
which then get the prefix `parsed_`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes that keep a cut between cells apart from anything a cell can hold.
_ESC, _ESC_SELF, _ESC_CUT = "\u0002", "\u0002\u0003", "\u0002\u0004"

COLUMNS = (
    "gkgrecordid", "date", "sourcecommonname", "documentidentifier", "v2locations", "v2persons", "v2organizations",
    "v15tone", "allnames",
)

_DECIMAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"


@dataclass(frozen=True)
class Rule:
    """`kind` names a validation of `VALIDATIONS`; a value of column `column` that doesn't hold fails with `reason`."""

    column: int
    kind: str
    reason: str


RULES = (Rule(1, "timestamp", "bad_date"), Rule(4, "locations", "bad_location"))


def delimiter(file_name: Column) -> Column:
    return F.when(file_name.endswith(".tsv"), F.lit("\t")).otherwise(F.lit(","))


def quoting_holds(pieces: Column, delim: Column) -> Column:
    """Whether a line cut at its quote marks is well quoted.

    Pieces 0, 2, 4 ... lie outside quotes. The last piece must be one of them; each must begin with a delimiter unless
    it is the first, end with one unless it is the last, and hold no line break. An empty piece in between is a
    doubled mark inside a quoted field.
    """
    last = F.size(pieces) - 1

    def wrong(piece: Column, i: Column) -> Column:
        inner_empty = (piece == "") & (i > 0) & (i < last)
        starts = (i == 0) | ((i == last) & (piece == "")) | piece.startswith(delim)
        ends = (i == last) | ((i == 0) & (piece == "")) | piece.endswith(delim)
        return (i % 2 == 0) & ~inner_empty & (~starts | ~ends | piece.rlike(r"[\r\n]"))

    bad = F.exists(F.transform(pieces, wrong), lambda x: x)
    return (last % 2 == 0) & ~bad


def cells(pieces: Column, delim: Column) -> Column:
    """The unquoted cells of a well quoted line cut at its quote marks (as for `quoting_holds`)."""
    last = F.size(pieces) - 1

    def outside(piece: Column, i: Column) -> Column:
        escaped = F.replace(piece, F.lit(_ESC), F.lit(_ESC_SELF))
        return (
            F.when(i % 2 == 1, escaped)
            .when((piece == "") & (i > 0) & (i < last), F.lit('"'))
            .otherwise(F.replace(escaped, delim, F.lit(_ESC_CUT)))
        )

    whole = F.array_join(F.transform(pieces, outside), "")
    return F.transform(F.split(whole, _ESC_CUT, -1), lambda x: F.replace(x, F.lit(_ESC_SELF), F.lit(_ESC)))


def is_blank(value: Column) -> Column:
    return ~value.rlike(r"[^\s   　]")


def real_timestamp(value: Column) -> Column:
    """Trimmed `value` is YYYYMMDD or YYYYMMDDHHMMSS and exists in the calendar."""
    v = F.regexp_replace(value, r"^[\s ]+|[\s ]+$", "")
    number = lambda start, length: F.substring(v, start, length).try_cast("int")
    year, month, day = number(1, 4), number(5, 2), number(7, 2)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    date = (year >= 1) & month.between(1, 12) & day.between(1, days)
    clock = (number(9, 2) < 24) & (number(11, 2) < 60) & (number(13, 2) < 60)
    return F.coalesce(v.rlike("^[0-9]{8}([0-9]{6})?$") & date & ((F.length(v) == 8) | clock), F.lit(False))


def real_locations(value: Column) -> Column:
    """Every `;`-separated block has 7, 8 or 9 fields, a type of digits and a latitude and longitude in range."""

    def block_holds(block: Column) -> Column:
        f = F.split(block, "#", -1)
        n = F.size(f)
        at = F.when(n == 7, 4).otherwise(5)
        lat, lon = F.get(f, at), F.get(f, at + 1)
        in_range = (F.abs(lat.try_cast("double")) <= 90) & (F.abs(lon.try_cast("double")) <= 180)
        plain = F.get(f, F.lit(0)).rlike("^[0-9]+$") & lat.rlike(_DECIMAL) & lon.rlike(_DECIMAL)
        return F.coalesce(n.between(7, 9) & plain & in_range, F.lit(False))

    return F.forall(F.split(value, ";", -1), block_holds)


#: Each validation holds for blank values too.
VALIDATIONS = {"timestamp": real_timestamp, "locations": real_locations}


def parse(lines: DataFrame, id_col: str = "line_id", file_col: str = "export_file", raw_col: str = "raw_line") -> DataFrame:
    """(id, well_quoted, cells) of each line."""
    delim = delimiter(F.col(file_col))
    return (
        lines.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(raw_col), F.lit("")).alias("raw"), delim.alias("delim"))
        .withColumn("pieces", F.split("raw", '"', -1))
        .select(
            "row_id",
            quoting_holds(F.col("pieces"), F.col("delim")).alias("well_quoted"),
            cells(F.col("pieces"), F.col("delim")).alias("cells"),
        )
    )


def rule_table(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.column, r.kind, r.reason) for r in rules]
    return lines.sparkSession.createDataFrame(rows, "column_no int, kind string, reason string")


def errors(lines: DataFrame, width: int = len(COLUMNS), rules: Sequence[Rule] = RULES, **columns: str) -> DataFrame:
    """(line_id, reason), one row for each line and reason. The rule table is a literal of a few rows, so it is broadcast."""
    parsed = parse(lines, **columns)
    structure = F.when(~F.col("well_quoted"), "quoting").when(F.size("cells") != width, "column_count")
    # A line whose structure fails is one row with its reason (in no column); any other a row for each cell. Only cells that a rule names go on.
    wanted = sorted({r.column for r in rules})
    entry = lambda c, value, reason: F.struct(F.lit(c).alias("column_no"), value.alias("value"), reason.alias("failed"))
    none = F.lit(None).cast("string")
    entries = F.when(structure.isNotNull(), F.array(entry(-1, none, structure))).otherwise(F.array(*(entry(c, F.get("cells", F.lit(c)), none) for c in wanted)))
    exploded = parsed.select(F.col("row_id").alias("line_id"), F.explode(entries).alias("e")).select("line_id", "e.*")
    checked = exploded.join(F.broadcast(rule_table(lines, rules)), "column_no", "left")
    verdict = F.lit(True)
    for kind, holds in VALIDATIONS.items():
        verdict = F.when(F.col("kind") == kind, holds(F.col("value"))).otherwise(verdict)
    reason = F.coalesce("failed", F.when(~is_blank(F.col("value")) & ~verdict, F.col("reason")))
    return checked.select("line_id", reason.alias("reason")).where("reason is not null").distinct()


def split_rows(
    lines: DataFrame, names: Sequence[str] = COLUMNS, rules: Sequence[Rule] = RULES, id_col: str = "line_id"
) -> tuple[DataFrame, DataFrame]:
    """The valid lines as typed rows, and the failed ones with the sorted array of their reasons."""
    failed = errors(lines, len(names), rules, id_col=id_col)
    per_line = failed.groupBy("line_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    clean_ids = parse(lines, id_col=id_col).join(failed, F.col("row_id") == F.col("line_id"), "left_anti")
    text = lambda i: F.get("cells", F.lit(i))
    taken = {id_col, *names}
    extra = [c for c in lines.columns if c not in taken and c not in ("export_file", "raw_line")]
    typed = clean_ids.select(F.col("row_id").alias(id_col), *(text(i).alias(n) for i, n in enumerate(names)))
    if "date" in names:
        v = F.regexp_replace("date", r"[^0-9]", "")
        padded = F.when(F.length(v) == 8, F.concat(v, F.lit("000000"))).otherwise(v)
        typed = typed.withColumn("date", F.when(v != "", F.to_timestamp(padded, "yyyyMMddHHmmss")))
    if "v2locations" in names:
        typed = typed.withColumn("v2locations", location_structs(F.col("v2locations")))
    return (typed.join(lines.select(id_col, *extra), id_col) if extra else typed), per_line


def location_structs(value: Column) -> Column:
    """A valid locations cell as array of structs; an empty array for a blank one."""

    def block(b: Column) -> Column:
        f = F.split(b, "#", -1)
        n = F.size(f)
        at = F.when(n == 7, 4).otherwise(5)
        return F.struct(
            F.get(f, F.lit(0)).try_cast("bigint").alias("type"),
            F.get(f, F.lit(1)).alias("name"),
            F.get(f, F.lit(2)).alias("country"),
            F.get(f, F.lit(3)).alias("adm1"),
            F.when(n > 7, F.get(f, F.lit(4))).alias("adm2"),
            F.get(f, at).try_cast("double").alias("lat"),
            F.get(f, at + 1).try_cast("double").alias("lon"),
            F.get(f, at + 2).alias("feature_id"),
            F.when(n == 9, F.get(f, F.lit(8))).try_cast("bigint").alias("char_offset"),
        )

    return F.when(is_blank(value), F.array().cast("array<struct<type:bigint,name:string,country:string,adm1:string,adm2:string,lat:double,lon:double,feature_id:string,char_offset:bigint>>")).otherwise(
        F.transform(F.split(value, ";", -1), block)
    )
