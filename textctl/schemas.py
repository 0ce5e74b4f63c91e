"""Names, fixed values and StructTypes shared by every operator.

The data model is long: one row per generated text, keyed by
``(task, model, prompt_id, aspect, iter)``. Wide (one array per aspect)
exists only at the file boundary; see ``operators.reshape``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: these must equal the benchmark's for right results. ---
# Aspect names, in the order of the generated-result columns and reports.
ASPECTS = ["format", "char_count", "keyword", "prohibited_word"]
# Task names, in the order of the task loop.
TASKS = ["summary", "ad_text", "pros_and_cons"]
# Text written in place of a cleaned text when the cleaning call failed.
SENTINEL = "Invalid Error"
# The only characters removed by blank deletion: space, ideographic space,
# newline, tab (not carriage return, not no-break space).
BLANKS = " 　\n\t"
# Format check compares this many leading and trailing characters.
FORMAT_EDGE = 10
# Labels of the control-score report lines, per aspect.
CTG_REPORT_LABELS = {
    "format": "Format",
    "char_count": "Char count",
    "keyword": "Keyword",
    "prohibited_word": "Prohibited word",
}
# Leaderboard column prefixes, per aspect.
BOARD_PREFIX = {
    "format": "Format",
    "char_count": "C-count",
    "keyword": "Keyword",
    "prohibited_word": "P-word",
}
# Judge answers: first question, then the fallback question.
JUDGE_LABELS = {"適切": True, "不適切": False}
JUDGE_BOOL_LABELS = {"True": True, "False": False}
# System message of the cleaning and judging calls.
ASSISTANT_SYSTEM = "あなたは指示に忠実に従うAIアシスタントです。ユーザーの指示に従って下さい。"
# Default number of generations per prompt and aspect.
DEFAULT_ITERS = 3
# --- end of fixed values ---

# Old aspect spellings accepted by the prompt builder.
ASPECT_ALIASES = {"char_num": "char_count", "keyword_use": "keyword"}

KEYS = ["task", "model", "prompt_id", "aspect", "iter"]

MASTER = T.StructType(
    [
        T.StructField("prompt_id", T.StringType()),  # numbers are read as their text
        T.StructField("title", T.StringType()),
        T.StructField("base_text", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("char_count", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("prohibited_word", T.StringType()),
        T.StructField("prompt_format", T.StringType()),
        T.StructField("prompt_char_count", T.StringType()),
        T.StructField("prompt_keyword", T.StringType()),
        T.StructField("prompt_prohibited_word", T.StringType()),
        T.StructField("char_count_answer", T.ArrayType(T.IntegerType())),
        T.StructField("keyword_answer", T.StringType()),
        T.StructField("prohibited_word_answer", T.StringType()),
    ]
)

_TEXTS = T.ArrayType(T.StringType())

RESULTS_WIDE = T.StructType(
    [
        T.StructField("generated_text_id", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_id", T.StringType()),  # numbers are read as their text
        T.StructField("base_text", T.StringType()),
    ]
    + [T.StructField(f"{a}_result", _TEXTS) for a in ASPECTS]
)

RESULTS_CLEAN_WIDE = T.StructType(
    RESULTS_WIDE.fields + [T.StructField(f"{a}_result_wo_hf", _TEXTS) for a in ASPECTS]
)


def canonical_aspect(name: str) -> str:
    """Map an aspect name or alias to its canonical name; raise on others."""
    name = ASPECT_ALIASES.get(name, name)
    if name not in ASPECTS:
        raise ValueError(f"unknown aspect {name!r}; expected one of {ASPECTS}")
    return name
