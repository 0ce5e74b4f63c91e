"""Chat templates, model routing and generation parameters.

Every family's prompt layout is a template with ``{text}`` (the task
prompt) and, for one family, ``{bos}``; hosted chat families send a
``system`` message next to the text. Routing a model path to a family is
an ordered rule list (substring rules first, then exact names), compiled to
one ``CASE`` expression; the parameter table is a literal map. Nothing here
needs a join: rules and templates are configuration, not data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import render
from ..schemas import ASSISTANT_SYSTEM

# --- Fixed values: prompt layouts per family, byte for byte. ---
# (template with the system prompt, template without it); {text} is the
# task prompt, {bos} the tokenizer's begin-of-sequence token.
CHAT_TEMPLATES = {
    "openai": ("{text}", "{text}"),
    "gemini": ("{text}", "{text}"),
    "calm2": ("USER: {text}\nASSISTANT: ", "USER: {text}\nASSISTANT: "),
    "elyza": (
        "{bos}[INST] <<SYS>>\nあなたは誠実で優秀な日本人のアシスタントです。\n<</SYS>>\n\n{text} [/INST] ",
        "{bos}[INST] <<SYS>>\n\n<</SYS>>\n\n{text} [/INST] ",
    ),
    "neox": (
        "ユーザー: Hello, you are an assistant that helps me learn Japanese.\nシステム: Sure, what can I do for you?\nユーザー: {text}\nシステム: ",
        "ユーザー: {text}\nシステム: ",
    ),
    "line": ("ユーザー: {text}\nシステム: ", "ユーザー: {text}\nシステム: "),
    "matsuo": (
        "以下は、タスクを説明する指示です。要求を適切に満たす応答を書きなさい。\n\n### 指示:\n{text}\n\n### 応答:",
        "指示:\n{text}\n\n### 応答:",
    ),
    "youri": (
        "設定: あなたは指示に忠実に従うAIアシスタントです。ユーザーの指示に従って下さい。\nユーザー: {text}\nシステム: ",
        "設定: \nユーザー: {text}\nシステム: ",
    ),
    "llmjp": ("{text}### 回答：", "{text}### 回答："),
    "stablelm": (
        "以下は、タスクを説明する指示と、文脈のある入力の組み合わせです。要求を適切に満たす応答を書きなさい。\n\n### 指示: \n{text}\n\n### 応答: \n",
        "\n\n### 指示: \n{text}\n\n### 応答: \n",
    ),
    "swallow": (
        "以下に、あるタスクを説明する指示があります。リクエストを適切に完了するための回答を記述してください。\n    \n### 指示:\n{text}\n    \n### 応答:",
        "{text}",
    ),
}
# The benchmark's neox layout with the system prompt leaves the user text
# out (its two example turns only); kept for compatibility runs.
NEOX_SYSTEM_COMPAT = "ユーザー: Hello, you are an assistant that helps me learn Japanese.\nシステム: Sure, what can I do for you?\nシステム: "
# System message of the hosted chat family, on / off.
CHAT_SYSTEM = {"openai": (ASSISTANT_SYSTEM, "")}
DEFAULT_BOS = "<s>"

# Loader routing: substring rules in order, then exact names.
LOADER_RULES = [
    ("cyberagent/calm2", "calm2"),
    ("elyza/ELYZA-japanese-", "elyza"),
    ("rinna/bilingual-gpt-", "neox"),
    ("line-corporation/japanese-large-lm-", "line"),
    ("matsuo-lab/weblab-10b-instruction-sft", "matsuo"),
    ("llm-jp/llm-jp-13b-instruct-full-", "llmjp"),
    ("rinna/youri-7b-chat", "youri"),
    ("stabilityai/japanese-stablelm-instruct-gamma-7b", "stablelm"),
    ("tokyotech-llm/Swallow-", "swallow"),
]
LOADER_EXACT = {"gemini-pro": "gemini", "gpt-4-1106-preview": "openai", "gpt-3.5-turbo-0125": "openai"}

# Renderer routing: exact model names.
RENDERER = {
    "cyberagent/calm2-7b-chat": "calm2",
    "rinna/bilingual-gpt-neox-4b-instruction-ppo": "neox",
    "rinna/bilingual-gpt-neox-4b-instruction-sft": "neox",
    "elyza/ELYZA-japanese-Llama-2-7b-fast-instruct": "elyza",
    "line-corporation/japanese-large-lm-3.6b-instruction-sft": "line",
    "matsuo-lab/weblab-10b-instruction-sft": "matsuo",
    "llm-jp/llm-jp-13b-instruct-full-jaster-v1.0": "llmjp",
    "llm-jp/llm-jp-13b-instruct-full-jaster-dolly-oasst-v1.0": "llmjp",
    "llm-jp/llm-jp-13b-instruct-full-dolly-oasst-v1.0": "llmjp",
    "rinna/youri-7b-chat": "youri",
    "stabilityai/japanese-stablelm-instruct-gamma-7b": "stablelm",
    "tokyotech-llm/Swallow-7b-instruct-hf": "swallow",
    "tokyotech-llm/Swallow-13b-instruct-hf": "swallow",
    "tokyotech-llm/Swallow-70b-instruct-hf": "swallow",
    "gemini-pro": "gemini",
    "gpt-4-1106-preview": "openai",
    "gpt-3.5-turbo-0125": "openai",
}

MAX_NEW_TOKENS = 4096
# Generation parameters per local family (None = not set, library default).
GEN_PARAMS = {
    "calm2": dict(do_sample=True, temperature=0.8, top_p=None, top_k=None, repetition_penalty=None, num_beams=None),
    "elyza": dict(do_sample=None, temperature=None, top_p=None, top_k=None, repetition_penalty=None, num_beams=None),
    "neox": dict(do_sample=True, temperature=1.0, top_p=0.85, top_k=None, repetition_penalty=None, num_beams=None),
    "line": dict(do_sample=True, temperature=0.7, top_p=0.9, top_k=0, repetition_penalty=1.1, num_beams=1),
    "matsuo": dict(do_sample=True, temperature=0.7, top_p=0.95, top_k=None, repetition_penalty=None, num_beams=None),
    "youri": dict(do_sample=True, temperature=0.5, top_p=None, top_k=None, repetition_penalty=None, num_beams=None),
    "llmjp": dict(do_sample=True, temperature=0.7, top_p=0.95, top_k=None, repetition_penalty=None, num_beams=None),
    "stablelm": dict(do_sample=True, temperature=1.0, top_p=0.95, top_k=None, repetition_penalty=None, num_beams=None),
    "swallow": dict(do_sample=True, temperature=0.99, top_p=0.95, top_k=None, repetition_penalty=None, num_beams=None),
}
# --- end of fixed values ---

FAMILIES = list(CHAT_TEMPLATES)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def loader_family(model_path) -> Column:
    """First substring rule that matches, else an exact name, else NULL."""
    m = _c(model_path)
    out = None
    for pattern, fam in LOADER_RULES:
        cond = m.contains(pattern)
        out = F.when(cond, F.lit(fam)) if out is None else out.when(cond, F.lit(fam))
    for name, fam in LOADER_EXACT.items():
        out = out.when(m == name, F.lit(fam))
    return out


def renderer_family(model_path) -> Column:
    """Exact model name, else NULL (unsupported)."""
    m = _c(model_path)
    out = None
    for name, fam in RENDERER.items():
        out = F.when(m == name, F.lit(fam)) if out is None else out.when(m == name, F.lit(fam))
    return out


def chat_prompt(family, text, use_system, bos=DEFAULT_BOS, compat: bool = False) -> Column:
    """The prompt string a family sends for ``text``."""
    fam, t, us = _c(family), _c(text), _c(use_system)
    values = {"text": t, "bos": F.lit(bos)}
    out = None
    for name, (on, off) in CHAT_TEMPLATES.items():
        on_t = NEOX_SYSTEM_COMPAT if (compat and name == "neox") else on
        branch = F.when(us, render(on_t, values)).otherwise(render(off, values))
        out = F.when(fam == name, branch) if out is None else out.when(fam == name, branch)
    return out


def chat_system(family, use_system) -> Column:
    """The system message for hosted chat families (NULL for the others)."""
    fam, us = _c(family), _c(use_system)
    out = F.lit(None).cast("string")
    for name, (on, off) in CHAT_SYSTEM.items():
        out = F.when(fam == name, F.when(us, F.lit(on)).otherwise(F.lit(off))).otherwise(out)
    return out


def chat_messages(family, text, use_system) -> Column:
    """Hosted chat request body: ``array<struct<role, content>>`` with the
    system message (empty string when switched off) and the user text;
    NULL for families that take a prompt string."""
    fam, t = _c(family), _c(text)
    msg = F.array(
        F.struct(F.lit("system").alias("role"), chat_system(fam, use_system).alias("content")),
        F.struct(F.lit("user").alias("role"), t.alias("content")),
    )
    return F.when(fam.isin(*CHAT_SYSTEM.keys()), msg)


_PARAM_TYPES = {"do_sample": "BOOLEAN", "temperature": "DOUBLE", "top_p": "DOUBLE", "top_k": "INT", "repetition_penalty": "DOUBLE", "num_beams": "INT"}


def _param_sql(v, t: str) -> str:
    text = "NULL" if v is None else (("TRUE" if v else "FALSE") if isinstance(v, bool) else repr(v))
    return f"CAST({text} AS {t})"


def gen_params(family: str = "family") -> Column:
    """Struct of generation parameters for the family in column
    ``family`` (NULL for remote families). The table is literal, so it is
    written as one SQL ``CASE`` over ``named_struct`` values."""
    from ..sources.registry import sql_str

    branches = []
    for name, p in GEN_PARAMS.items():
        fields = ", ".join(f"'{k}', {_param_sql(p[k], t)}" for k, t in _PARAM_TYPES.items())
        branches.append(f"WHEN {sql_str(name)} THEN named_struct({fields}, 'max_new_tokens', {MAX_NEW_TOKENS})")
    return F.expr(f"CASE `{family}` {' '.join(branches)} END")


def route(df: DataFrame, model_col: str = "model_path") -> DataFrame:
    """Add ``loader_family``, ``family`` (renderer) and ``supported``."""
    return df.withColumns(
        {
            "loader_family": loader_family(model_col),
            "family": renderer_family(model_col),
        }
    ).withColumn("supported", F.col("family").isNotNull() & F.col("loader_family").isNotNull())


def render_requests(requests: DataFrame, use_system: bool = True, bos: str = DEFAULT_BOS, compat: bool = False) -> DataFrame:
    """Route each request's model and render its chat prompt; requests of
    unsupported models keep ``chat_prompt`` NULL (see ``unsupported``)."""
    r = route(requests)
    return r.withColumns(
        {
            "use_system": F.lit(use_system),
            "chat_prompt": chat_prompt("family", "prompt", F.lit(use_system), bos, compat),
            "system": chat_system("family", F.lit(use_system)),
            "messages": chat_messages("family", "prompt", F.lit(use_system)),
            "params": gen_params("family"),
        }
    )


def unsupported_paths(models: list[tuple[int, str]]) -> list[str]:
    """The configured models without a renderer or a loader."""
    loads = lambda p: p in LOADER_EXACT or any(x in p for x, _ in LOADER_RULES)
    return [p for _, p in models if p not in RENDERER or not loads(p)]


def unsupported(requests: DataFrame) -> DataFrame:
    """Per model, the requests no renderer or loader can serve."""
    r = route(requests)
    return (
        r.where(~F.col("supported"))
        .groupBy("model_path", "loader_family", "family")
        .agg(F.count(F.lit(1)).alias("n_requests"))
    )
