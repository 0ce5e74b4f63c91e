"""Judge cells as VARIANT, against Python's own reading and writing of list
literals."""

import ast
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textctl.operators import judge as J
from textctl.operators import judge_cells as JC
from textctl.plans import queries as Q

from conftest import SF0001

HARD = ["", "'", '"', "'\"", "\\", "\\'", "\\\\", "a\\", "\x01", "\x01b", "\\\x01b", "], [", "True", "None", "1", "\ufeff", "\u3000全角", "é\x85\u2028", "😀\U000e0001", "\n\r\t\x00\x7f", "[", "a, b", "tr'ue\" \\n"]


def read(spark, cells):
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string").repartition(3)
    x = df.select("i", JC.parse_cell("c").alias("v")).select(
        "i", F.to_json("v").alias("j"), JC.kinds("v").alias("k"), JC.truths("v").alias("t"), JC.literal("v").alias("l")
    )
    return [r for r in sorted(x.collect())]


def test_reads_and_writes_as_python_does(spark):
    values = [HARD, [True, False, None], [], [0, -3, 7, 1.5, 0.0], [True, "判定できません", "", None]] + [[h] for h in HARD]
    for v, r in zip(values, read(spark, [repr(v) for v in values])):
        assert json.loads(r.j) == v and r.t == [bool(e) for e in v]
        assert r.l == repr(v)


def test_every_escape(spark):
    cells = [
        r"""['\x41\u3042\U0001F600\101\0\7z\a\b\f\n\r\t\v\'\"\\\q\(']""",
        '["it\'s", \'say "x"\', "\\"", \'\\\'\']',
        "['a\\\nb',]",
        " [ 1_000 , +5,-0,  .5, 2., 1e3 , True ] ",
        r"['\\\\\\'  , '\\\'']",
        "['\\ufeff\\U0010FFFF']",
    ]
    for c, r in zip(cells, read(spark, cells)):
        assert json.loads(r.j) == ast.literal_eval(c.strip()), c


def test_no_list_literal_gives_null(spark):
    bad = [None, "", "True", "[", "]", "[True", "True]", "[[True]]", "[True False]", "[,]", "[True,,False]", "['a' 'b']", "['a]", "[\"a']", "[true]", "['a'] x"]
    bad += [r"['\x4']", r"['\u12']", r"['\U00110000']", r"['\N{DASH}']", "[007]", "[1.2.3]", "[r'a']"]
    assert [r.j for r in read(spark, bad)] == [None] * len(bad)
    (r,) = read(spark, [r"['\ud800']"])
    assert json.loads(r.j) == ["\ufffd"]


def test_long_answers(spark):
    # escapes in their ten thousands: no recursion in patterns
    v = [("'\\\"\n" * 30_000) + "x" * 500_000, True]
    (r,) = read(spark, [repr(v)])
    assert json.loads(r.j) == v and r.l == repr(v)


elements = st.one_of(st.booleans(), st.none(), st.integers(-(2**63), 2**63 - 1), st.text(st.characters(codec="utf-8"), max_size=8), st.text("'\"\\\x01bqdsxuN{}[], \n", max_size=8))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(elements, max_size=5), min_size=10, max_size=30))
def test_round_trip(spark, values):
    got = read(spark, [repr(v) for v in values])
    assert [json.loads(r.j) for r in got] == values
    again = read(spark, [r.l for r in got])
    assert [r.j for r in again] == [r.j for r in got]


def test_table_and_back(spark):
    judged = Q.judged(spark, SF0001)
    cells = JC.from_judged(judged)
    back = JC.to_judged(JC.from_table(JC.to_table(cells)))
    cols = [*J.JKEYS, "ok", "raw"]
    assert back.count() == judged.count() > 0
    assert back.select(*cols).exceptAll(judged.select(*cols)).count() == 0
    assert back.where("raw is not null").count() > 0
    # the table of escaped literals that earlier files hold is read alike
    old = JC.to_judged(JC.from_table(J.judge_table(judged)))
    assert old.select(*cols).exceptAll(judged.select(*cols)).count() == 0
    scored = J.quality_scores(back).drop("n_fallback")
    assert scored.exceptAll(J.quality_scores(judged).drop("n_fallback")).count() == 0


def test_unreadable_cells_keep_their_literal(spark):
    t = spark.createDataFrame([("s", "m", 1, "[True]", "oops"), ("s", "m", 2, None, "[]")], "task string, model string, prompt_id long, format_wo_hf string, keyword_wo_hf string")
    rows = {(r.prompt_id, r.aspect): (None if r.cell is None else str(r.cell), r.literal) for r in JC.from_table(t).collect()}
    assert rows == {(1, "format"): ("[true]", None), (1, "keyword"): (None, "oops"), (2, "format"): (None, None), (2, "keyword"): ("[]", None)}
    assert JC.to_judged(JC.from_table(t)).count() == 1
