"""Prompt construction (B1-B5, B10): constraint selection and task, cleaning
and judge prompts rendered from template text by native ``concat``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import render_by
from ..functions.text import strip_echo
from ..schemas import ASPECTS, canonical_aspect

# --- Fixed values: prompt texts, byte for byte as the benchmark sends them. ---
# Task prompts; slots: {lmt} (constraint text), {base_text}.
TASK_PROMPTS = {
    "summary": """以下の条件で与えられた文章を要約して出力してください。
[条件]
{lmt}
[文章]
{base_text}
""",
    "ad_text": """以下の[文章]で与えられた説明文に対する広告文のタイトルを、[条件]に従って1つ作成してください。
[条件]
{lmt}
[文章]
{base_text}
""",
    "pros_and_cons": """{base_text}メリットとデメリットを以下の条件に従って文章で回答してください。
[条件]
{lmt}
""",
}

# Header/footer removal prompts; slot: {generated_result}.
CLEAN_PROMPTS = {
    "summary": """以下に提示している文章は、ある文章を生成AIを用いて要約した出力結果です。
出力には「要約」あるいはそれに類する単語を含むような文として、「以下の文章を要約します。」「【要約】」などの冒頭の説明文や「以上が要約結果になります。」などの文末の説明文が入っていることがあります。また、英語でこれらの説明文が与えられることもあります。
提示した文章に上記で述べた説明文が含まれていない場合には提示した文章をそのまま出力し、上記で述べた説明文が含まれている場合は提示した文章から説明文を除去したものを抜き出してください。文章の中間部分を編集する必要は一切ありません。文が入っていることがあります。また、英語でこれらの説明文が与えられることもあります。
[文章]
{generated_result}
""",
    "ad_text": """以下に提示している文章は、ある文章を元に作成した広告文のタイトルです。
出力には「広告文：」や「広告文を作成します」などの冒頭の接頭辞や説明文、「作成しました。」「このタイトルは、、」などの接尾辞やタイトルの後ろの説明文が含まれていることがあります。
提示した文章に上記で述べた説明文や接頭辞、接尾辞が含まれていない場合には、提示した文章をそのまま出力してください。「」や**などの記号で囲われている事例の場合、記号は全て残したまま出力してください。
上記で述べた説明文が含まれている場合は提示した文章から説明文や接頭辞、接尾辞を除去したものを抜き出してください。冒頭、末尾以外の中間部分を編集する必要は一切ありません。新しく文字を追加などをしないでください。

[文章]
{generated_result}
""",
    "pros_and_cons": """以下に提示している文章は、ある事象・事物についてのメリットとデメリットを生成AIに回答してもらった出力結果です。
文章の冒頭や末尾に「そこで、メリットとデメリットをご紹介いたします。」「あなたのご質問にお答えいたします。」「以上が〇〇に関するメリット・デメリットです。」など内容と関係のない説明文が付与されている場合は、その説明文を除去して出力してください。ただし、文の一部は変更せずに、該当の文全体を除去してください。
上記のような説明文が付与されていない場合は、提示している文章をそのまま出力してください。

[文章]
{generated_result}
""",
}

# Judge prompts with a 適切/不適切 answer; slots: {base_text}, {generated_result}.
JUDGE_PROMPTS = {
    "summary": """以下に要約した文章とその要約元の文章が提示されています。
要約した文章は要約元の文章を適切に要約できているかを判断してください。
適切に要約できている場合は「適切」、適切に要約できていない場合は「不適切」と回答してください。
ただし、要約元の文章から断定できない情報が要約した文章に含まれている場合も「不適切」と回答してください。
「適切」「不適切」のいずれかのみを出力し、説明文などは付与しないでください。
【要約元の文章】
{base_text}

【要約した文章】
{generated_result}
""",
    "ad_text": """以下に、ランディングページの説明文とその説明文をもとに作成した1つの広告文のタイトルがあります。
説明文の内容に基づいているタイトルを作成できているかを判断してください。
適切に作成できている場合は「適切」、適切に作成できていない場合は「不適切」と回答してください。
ただし、説明文とタイトルが完全に一致している事例とタイトルとして長すぎる事例も「不適切」と回答してください。
「適切」「不適切」のいずれかのみを出力し、説明文などは付与しないでください。

【説明文】
{base_text}

【広告文のタイトル】
{generated_result}
""",
    "pros_and_cons": """以下に提示している文章は、ある事象・事物についてのメリットとデメリットを生成AIに回答してもらった出力結果です。
出力結果が、メリット・デメリットの双方について言及できているか否かを回答してください。
言及できている場合は「適切」、言及できていない場合は「不適切」と回答してください。
「適切」「不適切」のいずれかのみを出力し、説明文などは付与しないでください。

【文章】
{generated_result}
""",
}

# Fallback judge prompts with a True/False answer; same slots.
JUDGE_BOOL_PROMPTS = {
    "summary": """以下に要約した文章とその要約元の文章が提示されています。
要約した文章は要約元の文章を適切に要約できているかを判断してください。
適切に要約できている場合はTrue、適切に要約できていない場合はFalseと回答してください。
ただし、要約元の文章から断定できない情報が要約した文章に含まれている場合もFalseと回答してください。
必ずTrue, Falseのいずれかの単語を1つだけ出力してください。
【要約元の文章】
{base_text}

【要約した文章】
{generated_result}
""",
    "ad_text": """以下に、ランディングページの説明文とその説明文をもとに作成した1つの広告文のタイトルがあります。
説明文の内容に基づいているタイトルを作成できているかを判断してください。
適切に作成できている場合はTrue、適切に作成できていない場合はFalseと回答してください。
ただし、説明文とタイトルが完全に一致している事例とタイトルとして長すぎる事例もFalseと回答してください。
必ずTrue, Falseのいずれかの単語を1つだけ出力してください。

【説明文】
{base_text}

【広告文のタイトル】
{generated_result}
""",
    "pros_and_cons": """以下に提示している文章は、ある事象・事物についてのメリットとデメリットを生成AIに回答してもらった出力結果です。
出力結果が、メリット・デメリットの双方について言及できているか否かを回答してください。
言及できている場合はTrue、言及できていない場合はFalseと回答してください。
必ずTrue, Falseのいずれかの単語を1つだけ出力してください。

【文章】
{generated_result}
""",
}
# --- end of fixed values ---


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def task_prompt(task, constraint_text, base_text) -> Column:
    """B2: NULL for an unknown task (the benchmark yields no prompt then)."""
    return render_by(_col(task), TASK_PROMPTS, {"lmt": _col(constraint_text), "base_text": _col(base_text)})


def clean_prompt(task, generated_result) -> Column:
    """Empty string for an unknown task."""
    return render_by(_col(task), CLEAN_PROMPTS, {"generated_result": _col(generated_result)}, default=F.lit(""))


def judge_prompt(task, generated_result, base_text, is_bool: bool = False) -> Column:
    """Empty string for an unknown task."""
    templates = JUDGE_BOOL_PROMPTS if is_bool else JUDGE_PROMPTS
    return render_by(
        _col(task),
        templates,
        {"generated_result": _col(generated_result), "base_text": _col(base_text)},
        default=F.lit(""),
    )


def constraints_long(master: DataFrame, aspects=None) -> DataFrame:
    """B1: one row per prompt and aspect with the constraint text as string.

    ``aspects`` accepts the old spellings ``char_num``/``keyword_use``; an
    unknown name raises here, at plan time.
    """
    names = [canonical_aspect(a) for a in (aspects or ASPECTS)]
    return master.select(
        "task",
        "prompt_id",
        "base_text",
        F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(a).cast("string").alias("constraint_text")) for a in names])).alias("c"),
    ).select("task", "prompt_id", "base_text", "c.aspect", "c.constraint_text")


def task_prompts(master: DataFrame, aspects=None) -> DataFrame:
    """B2 over a master table: ``(task, prompt_id, aspect, prompt)``; rows of
    unknown tasks are dropped as the benchmark builds no prompt for them."""
    c = constraints_long(master, aspects)
    return c.select(
        "task", "prompt_id", "aspect", task_prompt("task", "constraint_text", "base_text").alias("prompt")
    ).where(F.col("prompt").isNotNull())


def with_prompt_columns(master: DataFrame) -> DataFrame:
    """Add ``prompt_{aspect}`` columns to a master table (what the benchmark's
    master files carry)."""
    return master.withColumns(
        {f"prompt_{a}": task_prompt("task", F.col(a).cast("string"), "base_text") for a in ASPECTS}
    )


def remove_echo(df: DataFrame, output: str = "text", prompt: str = "prompt", out: str | None = None) -> DataFrame:
    """Drop the prompt from the start of a completion that repeats it."""
    return df.withColumn(out or output, strip_echo(output, prompt))
