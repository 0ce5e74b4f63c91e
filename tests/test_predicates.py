"""Golden edge cases of the per-text rules (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from textctl.functions import text as X
from textctl.sources.registry import model_slice, registry_paths

S = "Invalid Error"


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()
    return row["x"]


def fmt(spark, raw, clean):
    return one(spark, X.format_valid("raw", "clean"), raw=raw, clean=clean)


def test_format_cases(spark):
    assert fmt(spark, "anything at all here", S) is False
    assert fmt(spark, "abcdefghij", "abcdefghij") is None  # 10 chars: undecided
    assert fmt(spark, "abcdefghijk", "abcdefghijk") is True
    assert fmt(spark, "X" + "abcdefghijk", "abcdefghijk") is False
    s = "abcdefghijklmnopqrstuvwxyz0123"
    assert fmt(spark, s, s[:15] + "#" + s[16:]) is True  # middle not compared
    assert fmt(spark, "ab cd　ef\ngh\tijk", "abcdefghijk") is True
    assert fmt(spark, "abcdefghijk\r", "abcdefghijk") is False  # \r kept
    assert fmt(spark, "short", "abcdefghijk") is False


def test_char_count_cases(spark):
    def cc(text, lo, hi):
        df = spark.createDataFrame([(text, lo, hi)], "t string, lo int, hi int")
        return df.select(X.char_count_valid("t", "lo", "hi").alias("x")).first()["x"]

    assert cc("a" * 10, 10, 20) is True
    assert cc("a" * 9, 10, 20) is False
    assert cc("a" * 20, 10, 20) is True
    assert cc("a" * 21, 10, 20) is False
    assert cc("😀" * 10, 10, 10) is True  # code points
    assert cc("a" * 8 + "\n ", 10, 10) is True  # blanks count
    assert cc(S, 0, 99) is False


def test_keyword_and_prohibited(spark):
    assert one(spark, X.keyword_valid("t", "k"), t="Abc", k="abc") is False
    assert one(spark, X.keyword_valid("t", "k"), t="anything", k="") is True
    assert one(spark, X.prohibited_word_valid("t", "k"), t="anything", k="") is False
    assert one(spark, X.keyword_valid("t", "k"), t=S, k="Invalid") is False
    assert one(spark, X.prohibited_word_valid("t", "k"), t=S, k="zzz") is False


def test_delete_blank_only_four_characters(spark):
    assert one(spark, X.delete_blank("t"), t=" a　b\nc\td\re f") == "abcd\re f"


def test_judge_labels(spark):
    assert one(spark, X.judge_label("a"), a="不適切") is False
    assert one(spark, X.judge_label("a"), a=" 適　切\n") is True
    assert one(spark, X.judge_label("a"), a="適切です") is None
    assert one(spark, X.judge_bool_label("a"), a="true") is None
    assert one(spark, X.judge_bool_label("a"), a=" True") is True
    assert one(spark, X.judge_bool_label("a"), a="False\n") is False


def test_three_decimals_like_python(spark):
    values = [0.0625, 0.0375, 1 / 3, 2 / 3, 0.5, 0.0005, 0.0015, 0.0025, 0.9995, 0.1235, 1.0, 0.0, 0.0001]
    values += [k / n for n in (7, 9, 11, 16, 150, 333, 2000, 4000, 6000) for k in range(0, n + 1)]
    values += [(a + b + c + d) / 4 for a in range(0, 1000, 37) for b in (1, 5, 8) for c in (0, 3) for d in (2, 6, 7)]
    values += [m / 12000 for m in range(0, 12001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["f"] for r in df.select(X.fmt3("v").alias("f")).collect()]
    want = ["{:.3f}".format(v) for v in values]
    bad = [(v, g, w) for v, g, w in zip(values, got, want) if g != w]
    assert not bad, bad[:10]
    assert got[0] == "0.062" and got[1] == "0.037" and got[5] == "0.001"


def test_parse_bool_list(spark):
    df = spark.createDataFrame([("[True, False, '判定できません']",)], "c string")
    assert df.select(X.parse_bool_list("c").alias("x")).first()["x"] == [True, False, None]


def test_strip_echo(spark):
    assert one(spark, X.strip_echo("o", "p"), o="PROMPTanswer", p="PROMPT") == "answer"
    assert one(spark, X.strip_echo("o", "p"), o="answer only", p="PROMPT") == "answer only"


def test_registry_prefix_and_slice():
    assert registry_paths({"MODEL_PATH_0": "a", "MODEL_PATH_1": "b", "MODEL_PATH_3": "d", "OTHER": "x"}) == ["a", "b"]
    assert model_slice(["a", "b", "c"], 1, 5) == [(1, "b"), (2, "c")]
    assert model_slice(["a", "b"]) == [(0, "a"), (1, "b")]
    import pytest

    with pytest.raises(ValueError):
        model_slice(["a"], 1, None)


def test_parse_bool_list_is_quote_aware(spark):
    cells = {
        "[True, False, '判定, できません']": [True, False, None],
        "[True, 'a\\'b, True', \"it's, False\", False]": [True, None, None, False],
        "['x\r\n[y]', True]": [None, True],
        "['end\\\\', True]": [None, True],
        "[]": [],
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r["c"]: r["x"] for r in df.select("c", X.parse_bool_list("c").alias("x")).collect()}
    assert got == cells
