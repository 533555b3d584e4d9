import re

from pyspark.sql import functions as F

from tidemark.functions import text as op
from tidemark.operators import guards

GROUPS = {"result": r"입시\s*결과|경쟁률", "guide": r"모집\s*요강", "money": r"장학금?", "number": r"\d+(?:\.\d+)?"}
RULES = [
    guards.Rule("guide_download", near=(guards.Near("guide", "result", 6),)),
    guards.Rule("money_only", every=("money",), none=("result",), also=lambda t: F.char_length(t) < 30),
    guards.Rule("numbers", some=("number", "money"), every=("result",)),
]
TEXTS = ["2025 모집 요강 및 입시결과", "모집요강 .............. 입시 결과", "장학 안내", "장학 안내 " + "x" * 40, "경쟁률 4.5", "모집 요강만", "", None, "입시\n결과 12"]


def brute(t):
    t = t or ""
    held = {n for n, p in GROUPS.items() if re.search(p, t)}
    if {"guide", "result"} <= held and re.search(f"(?s)(?:{GROUPS['guide']}).{{0,6}}(?:{GROUPS['result']})", t):
        return held, "guide_download"
    if "money" in held and "result" not in held and len(t) < 30:
        return held, "money_only"
    return held, "numbers" if "result" in held and held & {"number", "money"} else "clean"


def test_guards_equal_a_search_for_each_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r.id: (set(r.groups), r.verdict) for r in guards.guarded(df, "text", GROUPS, RULES).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)} and len({v for _, v in got.values()}) == 4


def test_a_text_is_scanned_once(spark):
    plan = guards.guarded(spark.createDataFrame([("a",)], "text string"), "text", GROUPS, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


DATED = [
    ("원서 2026. 9.  8.(월) 10:00 ~ 9. 12. (금) 18:00, 발표 12월 5일", ["2026. 9. 8.(월) 10:00", "9. 12. (금) 18:00", "12월 5일"]),
    ("'26-3-1 그리고 ′26.3.1 또 2026년 3월 1일; 3월 1일", ["'26-3-1", "′26.3.1", "2026년 3월 1일", "3월 1일"]),
    ("13.5 12.45 1.32 2026.13.1", []),
    ("9.8, 9.8, 9. 8", ["9.8", "9. 8"]),
    ("", []), (None, None),
]


def test_dates_are_distinct_in_order_and_not_within_longer_ones(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATED)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", op.dates(F.col("t")).alias("d")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(DATED)}
    many = spark.createDataFrame([(" ".join(f"{m}월 {d}일" for m in range(1, 13) for d in range(1, 29)),)], "t string")
    assert len(many.select(op.dates(F.col("t")).alias("d")).first().d) == 80


def test_quota_numbers(spark):
    rows = [("모집 30명, 12.5%, 501, 0, 45% 30 500", [], [30, 500]), ("모집 30", ["7", " 9 ", "x", "900", "7"], [7, 9]), ("정원 30", ["0"], []), ("모집 3.5 1004", None, []), (None, ["4"], [4])]
    df = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(rows)], "i int, t string, g array<string>")
    got = {r.i: r.q for r in df.select("i", op.quota_numbers(F.col("t"), F.col("g"), "모집").alias("q")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_word_bounds_are_those_of_ascii_words(spark):
    groups = {"article": r"\b(?:die|les)\b", "signs": r"[\\b]\d", "slash": r"\\b"}
    texts = ["die Tür", "édie lesé", "xdie", "die_", "andie", "b7", "\\b", "ü-les-ü", "der dieß"]
    bound = lambda t: re.search(r"\b(?:die|les)\b", t, re.A)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: set(r.groups) for r in guards.guarded(df, "text", groups, []).collect()}
    want = {t: {n for n, held in (("article", bound(t)), ("signs", re.search(r"[\\b]\d", t)), ("slash", "\\b" in t)) if held} for t in texts}
    assert got == want and sum("article" in v for v in got.values()) == 4
