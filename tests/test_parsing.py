import csv
import io

from tessaline.operators import parsing

GOOD = "r,20240102030405,s,d,1#n#c#a#1.5#-2.5#f,p,o,t,n"
CASES = {
    1: (GOOD, set()),
    2: ('r,20240102,s,d,"1#n,m#c#a##1.5#-2.5#f",p,o,t,n', set()),
    3: ('r,20240102,s,d,"1#n""q""#c#a#b#1.5#-2.5#f#9",p,o,t,n', set()),
    4: ('r,20240102,s"x,d,,p,o,t,n', {"quoting"}),
    5: ('r,20240102,"s,d,,p,o,t,n', {"quoting"}),
    6: ('r,20240102,"s"x,d,,p,o,t,n', {"quoting"}),
    7: ("r,20240102,s,d,,p,o,t\n,n", {"quoting"}),
    8: ("r,20240102,s,d,,p,o,t", {"column_count"}),
    9: ("", {"column_count"}),
    10: ("r,20240230,s,d,,p,o,t,n", {"bad_date"}),
    11: ("r, 20240229 ,s,d, ,p,o,t,n", set()),
    12: ("r,,s,d,,p,o,t,n", set()),
    13: ("r,20240102250000,s,d,1#n#c#a#1.5#-2.5#f;,p,o,t,n", {"bad_date", "bad_location"}),
    14: ("r,20240102,s,d,1#n#c#a#91#-2.5#f,p,o,t,n", {"bad_location"}),
    15: ("r,20240102,s,d,x#n#c#a#1#-2.5#f,p,o,t,n", {"bad_location"}),
    16: ("r,20240102,s,d,1#n#c#a#1e1#-2.5#f,p,o,t,n", {"bad_location"}),
    17: ("r,20240102,s,d,1#n#c#a#nan#-2.5#f,p,o,t,n", {"bad_location"}),
    18: ('"","",,,,,,,""', set()),
    19: ('r,20240102,s,d,,p,o,t,"a\nb"', set()),
    20: ("r,20240102,s,d,1#n#c#a#90#-180#f,p,o,t,n", set()),
    21: ('""', {"column_count"}),
    22: ('r,20240102,""s"",d,,p,o,t,n', {"quoting"}),
}


def lines(spark, cases, file="x.csv"):
    rows = [(k, file, v) for k, v in cases]
    return spark.createDataFrame(rows, "line_id bigint, export_file string, raw_line string")


def test_reasons(spark):
    got: dict[int, set] = {k: set() for k in CASES}
    for r in parsing.errors(lines(spark, [(k, v[0]) for k, v in CASES.items()])).collect():
        got[r.line_id].add(r.reason)
    assert got == {k: v[1] for k, v in CASES.items()}


def test_cells_agree_with_csv(spark):
    good = [(k, v[0]) for k, v in CASES.items() if "quoting" not in v[1]]
    got = {r.row_id: list(r.cells) for r in parsing.parse(lines(spark, good)).collect()}
    for k, text in good:
        want = next(csv.reader(io.StringIO(text, newline="")), [""]) or [""]
        assert got[k] == want


def test_tabs_null_and_empty(spark):
    df = lines(spark, [(1, GOOD.replace(",", "\t")), (2, None)], "a.tsv")
    assert {(r.line_id, r.reason) for r in parsing.errors(df).collect()} == {(2, "column_count")}
    assert parsing.errors(df.limit(0)).count() == 0


def test_typed_rows_keep_other_columns(spark):
    df = lines(spark, [(1, GOOD), (2, "x")]).selectExpr("*", "7 as extra")
    valid, failed = parsing.split_rows(df)
    row = valid.collect()
    assert len(row) == 1 and row[0].extra == 7 and row[0].v2locations[0].lat == 1.5
    assert [(r.line_id, r.reasons) for r in failed.collect()] == [(2, ["column_count"])]
