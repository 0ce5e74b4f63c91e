"""Golden hashes of every rendered prompt, independent of the operators'
constants: a changed character in a template or layout fails here."""

import hashlib

from pyspark.sql import functions as F

from textctl.operators import chat as CH
from textctl.operators import prompts as P

# family, system prompt on: first 16 hex digits of SHA-256 of the prompt and of the system message
CHAT = [
    ("openai", True, "e61fcef950717da4", "7a732d5aeb083bd8"),
    ("openai", False, "e61fcef950717da4", "e3b0c44298fc1c14"),
    ("gemini", True, "e61fcef950717da4", "e3b0c44298fc1c14"),
    ("gemini", False, "e61fcef950717da4", "e3b0c44298fc1c14"),
    ("calm2", True, "5e36527a6193a34d", "e3b0c44298fc1c14"),
    ("calm2", False, "5e36527a6193a34d", "e3b0c44298fc1c14"),
    ("elyza", True, "d5b2537403b08579", "e3b0c44298fc1c14"),
    ("elyza", False, "99c06874ea9c2614", "e3b0c44298fc1c14"),
    ("neox", True, "fa3c88d9149cb3ef", "e3b0c44298fc1c14"),
    ("neox", False, "5a3d60017c2d157c", "e3b0c44298fc1c14"),
    ("line", True, "5a3d60017c2d157c", "e3b0c44298fc1c14"),
    ("line", False, "5a3d60017c2d157c", "e3b0c44298fc1c14"),
    ("matsuo", True, "57936df6af6ac7ae", "e3b0c44298fc1c14"),
    ("matsuo", False, "081112f6743bf5bc", "e3b0c44298fc1c14"),
    ("youri", True, "443d0c8afc46c94c", "e3b0c44298fc1c14"),
    ("youri", False, "b674a4cad588efc7", "e3b0c44298fc1c14"),
    ("llmjp", True, "15cf52d90ed3b283", "e3b0c44298fc1c14"),
    ("llmjp", False, "15cf52d90ed3b283", "e3b0c44298fc1c14"),
    ("stablelm", True, "3701935ccabe90f5", "e3b0c44298fc1c14"),
    ("stablelm", False, "c6203a08c8a28858", "e3b0c44298fc1c14"),
    ("swallow", True, "bdf91130a7bf3043", "e3b0c44298fc1c14"),
    ("swallow", False, "e61fcef950717da4", "e3b0c44298fc1c14"),
]
# task: task prompt, cleaning prompt, judge prompt, fallback judge prompt
PROMPTS = [
    ("summary", "73cb6fc120ec90e8", "384f079826ad66b5", "d20a8b39ca014d9f", "d15abdc7b2890ea5"),
    ("ad_text", "6a41799f614b7e9f", "1ac84e1b48a59dbf", "cb7caf4de6a043b0", "4ab13a011382c2fe"),
    ("pros_and_cons", "8fd84709c19a5623", "2dc20e838508af5a", "5d7be8732f8145ad", "37779a5212006e2b"),
]


def _hash(text):
    return hashlib.sha256((text or "").encode()).hexdigest()[:16]


def test_chat_layouts(spark):
    assert {f for f, *_ in CHAT} == set(CH.FAMILIES)
    cols = [x for f, on, *_ in CHAT for x in (CH.chat_prompt(F.lit(f), F.lit("本文 text"), F.lit(on)), CH.chat_system(F.lit(f), F.lit(on)))]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert [_hash(x) for x in row] == [h for *_, p, s in CHAT for h in (p, s)]


def test_prompts(spark):
    text, base = F.lit("生成"), F.lit("本文")
    for task, *want in PROMPTS:
        t = F.lit(task)
        row = spark.range(1).select(
            P.task_prompt(t, F.lit("制約"), base).alias("a"),
            P.clean_prompt(t, text).alias("b"),
            P.judge_prompt(t, text, base).alias("c"),
            P.judge_prompt(t, text, base, is_bool=True).alias("d"),
        ).first()
        assert [_hash(x) for x in row] == want
