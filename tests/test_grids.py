from pyspark.sql import functions as F

from tidemark.operators import grids

CUTS = [
    ["above", "1"], ["grade", "Korean", "", "", "Math", "n", ""], ["1", "131", "1,200", "4.1", "133", "", ""], ["2", "", " ", "", "125", "x"], ["10", "9"], [], ["3"], ["grade", " ", ""], ["2", "100"], ["grade", "", "English"], [" 9 ", "5", "90", "7", "bad"],
]
DISTRIBUTION = [["", "Korean", "", "", "", "", "Math"], ["x", "score", "m", "f", "t", "c", "score", "m"], ["", "140", "1", "2", "3", "3", "99", "7"], ["", "", "1"], ["", "139", "x"], ["total", "1", "2"], ["", "138", "1"], ["", "A"], ["", "score", "m"], ["", "7", "8"], ["", " "], ["", "6", "8"], ["score", "m"], ["5", "5"]]


def frame(spark, rows):
    df = spark.createDataFrame([(s, i, c) for s in ("a", "b") for i, c in enumerate(rows)], "sheet string, line long, cells array<string>")
    return df.repartition(3)


def test_grade_cuts_read_each_row_by_the_header_above(spark):
    got = sorted(tuple(r) for r in grids.grade_cuts(frame(spark, CUTS), "sheet", "line", "cells", "grade").filter("sheet = 'a'").drop("sheet").collect())
    assert got == [(2, 1, "Korean", 1, "131", 1200, 4.1), (2, 1, "Math", 1, "133", None, None), (3, 1, "Math", 2, "125", None, None), (3, 1, "n", 2, "x", None, None), (10, 9, "English", 9, "90", 7, None)]


def test_distributions_end_at_totals_blanks_and_marks(spark):
    got = sorted(tuple(r) for r in grids.distributions(frame(spark, DISTRIBUTION), "sheet", "line", "cells", "score", "m", "total").filter("sheet = 'b'").drop("sheet").collect())
    assert got == [(2, "Korean", 140, 1, 2, 3, 3), (2, "Math", 99, 7, None, None, None), (4, "Korean", 139, None, None, None, None), (9, "A", 7, 8, None, None, None)]


def test_blocks_have_one_window_and_no_join(spark):
    plan = grids.grade_cuts(frame(spark, CUTS), "sheet", "line", "cells", "grade").groupBy().agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
