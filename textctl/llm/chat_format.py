"""Chat formatting by Spark expressions alone.

The turns of a conversation are collected as structs and sorted by turn,
adjacent turns of one role are merged by array functions, and the merged
turns are concatenated with a template:

    <|im_start|>role
    text<|im_sep|>text of the same role<|im_end|>

Texts cannot forge the template: between ``<`` and ``|`` (and any
backslashes already there) one backslash is put in, so no ``<|`` is left in
a text; ``unescaped`` takes exactly that backslash out again. In roles ``%``,
line ends and ``|`` become ``%25``, ``%0A`` and ``%7C``. ``read_back`` gives
the turns again, one by one, from the formatted text alone.

``loss`` lists the spans (start and length in code points of the formatted
text) that a model is trained on: the texts of ``loss_roles``, without
headers, separators or ends.

Defined results: a null text, role is an empty one; turns are ordered by
turn, nulls first, then by role and text, so ties and repeated rows have a
fixed order and stay; rows without a conversation id are one conversation; an
empty table gives an empty result; other columns are ignored. The formatted
text is one value, so a conversation is bounded by Spark's 2 GB for a value;
its rows meet in the task that writes it, conversations do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textctl.session import prepare

# The template's control strings.
START = "<|im_start|>"
SEP = "<|im_sep|>"
END = "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role_escaped(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("|", "%7C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_unescaped(role: Column) -> Column:
    for plain, code in (("|", "%7C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _merged(turns: Column) -> Column:
    """Sorted turns to ``array<struct<role, texts>>``, one per run of a role;
    a run is a slice from its first turn to the next run's."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(turns)), F.array(F.size(turns)))
    run = lambda r: F.slice(turns, r["from"] + 1, r["to"] - r["from"])
    return F.transform(
        F.arrays_zip(starts.alias("from"), ends.alias("to")),
        lambda r: F.struct(F.get(turns, r["from"])["role"].alias("role"), F.transform(run(r), lambda t: t["text"]).alias("texts")),
    )


def _parts(blocks: Column, loss_roles: Sequence[str]) -> Column:
    """Per text: the template's characters before it, its length, and
    whether it is trained on."""
    between = F.lit(len(END) + 1)
    header = lambda b: F.length(b["role"]) + len(START) + 1
    lead = lambda b, i, j: F.when(j > 0, F.lit(len(SEP))).when(i > 0, header(b) + between).otherwise(header(b))
    trained = [_role_escaped(F.lit(r)) for r in loss_roles]
    return F.flatten(
        F.transform(
            blocks,
            lambda b, i: F.transform(
                b["texts"], lambda t, j: F.struct(lead(b, i, j).cast("long").alias("lead"), F.length(t).cast("long").alias("length"), b["role"].isin(*trained).alias("loss"))
            ),
        )
    )


def _spans(parts: Column) -> Column:
    """The trained parts as spans, by one pass that counts characters."""
    none = F.array().cast("array<struct<start: bigint, length: bigint>>")
    step = lambda a, x: F.struct(
        (a["at"] + x["lead"] + x["length"]).alias("at"),
        F.when(x["loss"], F.array_append(a["spans"], F.struct((a["at"] + x["lead"]).alias("start"), x["length"].alias("length")))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def formatted(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",), conv_col: str = "conv_id") -> DataFrame:
    """Per conversation: its id, ``n_blocks`` (merged turns), ``formatted``
    and ``loss``."""
    prepare(turns.sparkSession)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(F.col(conv_col).alias("__conv"), F.struct("turn", role.alias("role"), text.alias("text")).alias("__turn"))
    # sorted by roles and texts as they are, escaped only then
    out = rows.groupBy("__conv").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    clean = F.transform("__turns", lambda t: F.struct(_role_escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    out = out.select("__conv", clean.alias("__turns"))
    out = out.select("__conv", _merged(F.col("__turns")).alias("__blocks"))
    block = lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n"))
    return out.select(
        F.col("__conv").alias(conv_col),
        F.size("__blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("__blocks", block), "").alias("formatted"),
        _spans(_parts(F.col("__blocks"), loss_roles)).alias("loss"),
    )


def read_back(text: Column) -> Column:
    """A formatted text's turns, ``array<struct<role, text>>``."""
    quoted = lambda s: s.replace("|", r"\|")
    blocks = F.slice(F.split(text, quoted(START)), 2, F.length(text))
    role = lambda b: F.substring_index(b, "\n", 1)
    body = lambda b: F.substring(b, F.length(role(b)) + 2, F.length(b) - F.length(role(b)) - (len(END) + 2))
    turns = lambda b: F.transform(F.split(body(b), quoted(SEP)), lambda t: F.struct(_role_unescaped(role(b)).alias("role"), unescaped(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def loss_texts(text: Column, loss: Column) -> Column:
    """The texts under the loss spans, unescaped."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(out: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = out.select(conv_col, "n_blocks", "formatted", read_back(F.col("formatted")).alias("__turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("__loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        conv_col,
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("__turns", line), ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
