"""Seeded property tests: the native predicates against a plain Python
statement of the same rules, on generated texts (blanks of all kinds,
carriage returns, emoji, Japanese, the sentinel)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from textctl.functions import text as X

SENT = "Invalid Error"
ALPHABET = list("ab xyz　\n\t\r😀あ要約") + ["Invalid Error"]


def py_blank(s):
    return "".join(c for c in s if c not in " 　\n\t")


def py_format(raw, clean):
    if clean == SENT:
        return False
    r, k = py_blank(raw), py_blank(clean)
    if len(k) > 10:
        return r[:10] == k[:10] and r[-10:] == k[-10:]
    return None


def py_keyword(clean, kw):
    return False if clean == SENT else kw in clean


def py_prohibited(clean, w):
    return False if clean == SENT else w not in clean


def py_count(clean, lo, hi):
    return False if clean == SENT else lo <= len(clean) <= hi


texts = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.just(SENT)
words = st.lists(st.sampled_from(list("abxy要😀 ")), max_size=3).map("".join)
cases = st.lists(st.tuples(texts, texts, words, st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60)


@settings(max_examples=15, deadline=None, derandomize=True)
@given(cases)
def test_predicates_match_python(spark, rows):
    df = spark.createDataFrame(rows, "raw string, clean string, w string, a int, b int")
    out = df.select(
        X.format_valid("raw", "clean").alias("f"),
        X.keyword_valid("clean", "w").alias("k"),
        X.prohibited_word_valid("clean", "w").alias("p"),
        X.char_count_valid("clean", "a", "b").alias("c"),
        X.delete_blank("raw").alias("nb"),
    ).collect()
    for (raw, clean, w, a, b), r in zip(rows, out):
        assert r["f"] == py_format(raw, clean)
        assert r["k"] == py_keyword(clean, w)
        assert r["p"] == py_prohibited(clean, w)
        assert r["c"] == py_count(clean, a, b)
        assert r["nb"] == py_blank(raw)
        # keyword and prohibited word are complementary unless sentinel
        if clean != SENT:
            assert r["k"] != r["p"]


blank_runs = st.lists(
    st.one_of(st.sampled_from(list("abxy要😀\r")), st.integers(1, 30).map(lambda k: " " * k), st.integers(1, 20).map(lambda k: "\n\t　" * k)),
    max_size=25,
).map("".join)
edge_cases = st.lists(st.tuples(blank_runs, blank_runs), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, derandomize=True)
@given(edge_cases)
def test_format_edges_from_windows_match_whole_text(spark, rows):
    """The format rule reads a window at each end and falls back to the
    whole text; small windows force the fallback on long blank runs."""
    df = spark.createDataFrame(rows, "raw string, clean string")
    windows = (11, 12, 16, 64)
    cols = []
    for w in windows:
        cols += [
            X.format_valid("raw", "clean", window=w).alias(f"f{w}"),
            X.first_nonblank("raw", 10, w).alias(f"a{w}"),
            X.last_nonblank("raw", 10, w).alias(f"z{w}"),
            X.nonblank_more_than("clean", 10, w).alias(f"m{w}"),
        ]
    out = df.select(*cols).collect()
    for (raw, clean), r in zip(rows, out):
        for w in windows:
            assert r[f"f{w}"] == py_format(raw, clean), (raw, clean, w)
            assert r[f"a{w}"] == py_blank(raw)[:10]
            assert r[f"z{w}"] == py_blank(raw)[-10:] if py_blank(raw) else r[f"z{w}"] == ""
            assert r[f"m{w}"] == (len(py_blank(clean)) > 10)
