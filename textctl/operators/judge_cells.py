"""The cells of the judge table as VARIANT.

A cell holds what a judge said of one text's iterations: booleans where an
answer parsed, the kept answer as text where none did. As a VARIANT array
both keep their type; as the judge file's list literal (``[True, False,
'…']``) they are read and written here without loss.

Reading is a state machine over tokens, all in native expressions:

1. escaped backslashes and quotes become two-character codes, so that a
   string is whatever stands between two equal quotes (no nested pattern, no
   recursion however long an answer is);
2. one pattern cuts the cell into strings, brackets, commas and words;
3. a fold over the tokens follows the states *start, open, after a value,
   after a comma, closed, failed*;
4. every value becomes a VARIANT: ``True``/``False``, ``None`` (null),
   integers (beyond 64 bits: a double), floats and strings with their escapes
   resolved.

Defined results: a NULL cell and one that is no flat list literal (nested
lists, two values without a comma, a bad or named escape) give NULL;
``[]`` an empty array; a trailing comma is allowed, as are line ends inside a
string. A lone surrogate escape becomes U+FFFD.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ASPECTS

CELL_KEYS = ["task", "model", "prompt_id", "aspect"]

#: Starts a code; itself coded, so that codes are unambiguous.
_CODE = "\x01"
#: What is coded (in this order) and the letter of its code.
_CODES = (("\x01", "s"), ("\\\\", "b"), ("\\'", "q"), ('\\"', "d"))
_PLAIN = {"s": "\x01", "b": "\\", "q": "'", "d": '"'}
_TOKEN = r"""'[^']*+'|"[^"]*+"|[\[\],]|[^\s\[\],'"]++|['"]"""
_INT = r"\A[+-]?(?:0++|[1-9][0-9]*+(?:_[0-9]++)*+)\z"
_FLOAT = r"\A[+-]?(?:(?:[0-9]++\.[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+|[0-9]++[eE][+-]?[0-9]++)\z"
_BAD_ESCAPE = r"\\(?:x(?![0-9A-Fa-f]{2})|u(?![0-9A-Fa-f]{4})|U(?!00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4})|N|\z)"
_PIECE = r"(?s)\x01.|\\(?:x..|u.{4}|U.{8}|[0-7]{1,3}+|.)|[^\x01\\]++"
#: Escapes of one letter; a line end after a backslash joins two lines.
_LETTERS = {"a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b", "\n": ""}
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_RUN = r"(?s)[^\p{C}\p{Z}]++|."

_START, _OPEN, _VALUE, _COMMA, _CLOSED, _FAILED = range(6)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _char(point: Column) -> Column:
    """The character of a code point (the byte order mark in front keeps
    U+FEFF from being read as one)."""
    shown = F.when(point.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(point)
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(shown), 8, "0"))), "UTF-32")


def _piece(p: Column) -> Column:
    """What a piece of a string stands for: a code, an escape or plain text."""
    second, rest = F.substr(p, F.lit(2), F.lit(1)), F.substr(p, F.lit(3))
    coded = F.lit(None).cast("string")
    for letter, plain in _PLAIN.items():
        coded = F.when(second == F.lit(letter), F.lit(plain)).otherwise(coded)
    escaped = F.when(second.isin("x", "u", "U"), _char(F.conv(rest, 16, 10).cast("long")))
    escaped = escaped.when(second.between("0", "7"), _char(F.conv(F.substr(p, F.lit(2)), 8, 10).cast("long")))
    for letter, plain in _LETTERS.items():
        escaped = escaped.when(second == F.lit(letter), F.lit(plain))
    return F.when(p.startswith(F.lit(_CODE)), coded).when(p.startswith(F.lit("\\")), escaped.otherwise(p)).otherwise(p)


def _string(token: Column) -> Column:
    """The text of a quoted token."""
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    pieces = F.transform(F.regexp_extract_all(inner, F.lit(_PIECE), F.lit(0)), _piece)
    return F.when(inner.contains(F.lit(_CODE)) | inner.contains(F.lit("\\")), F.array_join(pieces, "")).otherwise(inner)


def _quoted(token: Column) -> Column:
    return (F.length(token) > 1) & (token.startswith(F.lit("'")) | token.startswith(F.lit('"')))


def _variant(token: Column) -> Column:
    plain = F.regexp_replace(token, "_", "")
    number = F.coalesce(F.when(token.rlike(_INT), plain.try_cast("long")).cast("variant"), plain.try_cast("double").cast("variant"))
    return (
        F.when(_quoted(token), _string(token).cast("variant"))
        .when(token.isin("True", "False"), (token == F.lit("True")).cast("variant"))
        .when(token == F.lit("None"), F.parse_json(F.lit("null")))
        .otherwise(number)
    )


def _step(state: Column, token: Column) -> Column:
    """The state after a token."""
    word = token.isin("True", "False", "None") | token.rlike(_INT) | token.rlike(_FLOAT)
    value = F.when(_quoted(token), ~token.rlike(_BAD_ESCAPE)).otherwise(word)
    return (
        F.when(token == F.lit("["), F.when(state == _START, F.lit(_OPEN)).otherwise(F.lit(_FAILED)))
        .when(token == F.lit("]"), F.when(state.isin(_OPEN, _VALUE, _COMMA), F.lit(_CLOSED)).otherwise(F.lit(_FAILED)))
        .when(token == F.lit(","), F.when(state == _VALUE, F.lit(_COMMA)).otherwise(F.lit(_FAILED)))
        .otherwise(F.when(state.isin(_OPEN, _COMMA) & value, F.lit(_VALUE)).otherwise(F.lit(_FAILED)))
    )


def parse_cell(cell) -> Column:
    """A list literal as a VARIANT array (A6); NULL where it is none."""
    coded = F.col(cell) if isinstance(cell, str) else cell
    for text, letter in _CODES:
        coded = F.replace(coded, F.lit(text), F.lit(_CODE + letter))

    def read(tokens: Column) -> Column:
        values = F.transform(F.filter(tokens, lambda t: ~t.isin("[", "]", ",")), _variant)
        closed = F.aggregate(tokens, F.lit(_START), _step) == F.lit(_CLOSED)
        return F.when(closed, F.to_variant_object(values))

    return _let(F.regexp_extract_all(coded, F.lit(_TOKEN), F.lit(0)), read)


def _each(cell, body: Callable[[Column], Column]) -> Column:
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.transform(cell.cast("array<variant>"), body)


def kinds(cell) -> Column:
    """The type of every element: ``BOOLEAN``, ``STRING``, ``VOID``, …"""
    return _each(cell, F.schema_of_variant)


def _when(kind: str, e: Column, type_: str) -> Column:
    """The element as ``type_`` if it is of that kind: a text that reads
    ``true`` is no boolean."""
    return F.when(F.schema_of_variant(e) == F.lit(kind), e.cast(type_))


def labels(cell) -> Column:
    """Booleans as such, NULL for every other element: what accuracy counts."""
    return _each(cell, lambda e: _when("BOOLEAN", e, "boolean"))


def answers(cell) -> Column:
    """Kept answers as text, NULL for every other element."""
    return _each(cell, lambda e: _when("STRING", e, "string"))


def truths(cell) -> Column:
    """Every element by truthiness, as the benchmark reads a judge file back
    (Q25): a kept answer counts as true unless it is empty."""

    def truth(e: Column) -> Column:
        kind = F.schema_of_variant(e)
        return (
            F.when(kind == F.lit("BOOLEAN"), e.cast("boolean"))
            .when(kind == F.lit("STRING"), e.cast("string") != F.lit(""))
            .when(kind == F.lit("VOID"), F.lit(False))
            .otherwise(e.cast("double") != F.lit(0.0))
        )

    return _each(cell, truth)


def _escape(p: Column) -> Column:
    """An unprintable character as the shortest hexadecimal escape."""
    point = F.ascii(p)
    hexed = F.lower(F.hex(point))
    return (
        F.when(point < 0x100, F.concat(F.lit("\\x"), F.lpad(hexed, 2, "0")))
        .when(point < 0x10000, F.concat(F.lit("\\u"), F.lpad(hexed, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(hexed, 8, "0")))
    )


def quoted(text: Column) -> Column:
    """A string literal: in single quotes, or in double ones if the text has
    single quotes alone; what cannot be printed is escaped."""
    both = F.when(text.contains(F.lit("'")) & ~text.contains(F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.when(both == F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'"))).otherwise(out)
    for plain, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    pieces = F.regexp_extract_all(out, F.lit(_RUN), F.lit(0))
    shown = F.transform(pieces, lambda p: F.when((p != F.lit(" ")) & p.rlike(r"\A" + _UNPRINTABLE), _escape(p)).otherwise(p))
    return F.concat(both, F.when(out.rlike(_UNPRINTABLE), F.array_join(shown, "")).otherwise(out), both)


def literal(cell) -> Column:
    """The list literal of a VARIANT cell; ``parse_cell`` gives the cell back.
    Numbers are written as JSON writes them."""

    def one(e: Column) -> Column:
        kind = F.schema_of_variant(e)
        return (
            F.when(kind == F.lit("BOOLEAN"), F.initcap(e.cast("string")))
            .when(kind == F.lit("VOID"), F.lit("None"))
            .when(kind == F.lit("STRING"), quoted(e.cast("string")))
            .otherwise(F.to_json(e))
        )

    return F.concat(F.lit("["), F.array_join(_each(cell, one), ", "), F.lit("]"))


def from_judged(judged: DataFrame) -> DataFrame:
    """One VARIANT ``cell`` per text and aspect from judged rows (``ok``,
    ``raw``), in the order of iterations; neither label nor answer: null.
    A group holds the iterations of one text."""
    group = judged.groupBy(*CELL_KEYS).agg(F.array_sort(F.collect_list(F.struct("iter", "ok", "raw"))).alias("xs"))
    null = F.parse_json(F.lit("null"))
    values = F.transform("xs", lambda x: F.coalesce(x["ok"].cast("variant"), x["raw"].cast("variant"), null))
    return group.select(*CELL_KEYS, F.to_variant_object(values).alias("cell"))


def from_table(table: DataFrame) -> DataFrame:
    """The VARIANT cells of a judge table (``task, model, prompt_id`` and one
    literal column ``{aspect}_wo_hf`` per aspect; missing aspects have no
    rows). ``literal`` stays where a cell could not be read."""
    there = [a for a in ASPECTS if f"{a}_wo_hf" in table.columns]
    per = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"`{a}_wo_hf`").alias("literal")) for a in there])
    long = table.select("task", "model", "prompt_id", F.inline(per)).withColumn("cell", parse_cell("literal"))
    return long.select(*CELL_KEYS, "cell", F.when(F.col("cell").isNull(), F.col("literal")).alias("literal"))


def to_judged(cells: DataFrame) -> DataFrame:
    """Judged rows of VARIANT cells: ``iter``, ``kind``, ``ok``, ``raw`` and
    ``truth`` (Q25); ``stage`` tells parsed rows (``read``) from kept answers."""
    per = F.arrays_zip(kinds("cell").alias("kind"), labels("cell").alias("ok"), answers("cell").alias("raw"), truths("cell").alias("truth"))
    x = cells.select(*CELL_KEYS, F.posexplode(per).alias("iter", "v"))
    stage = F.when(F.col("v.ok").isNotNull(), F.lit("read")).otherwise(F.lit("unparsed"))
    return x.select(*CELL_KEYS, F.col("iter").cast("int").alias("iter"), "v.kind", "v.ok", "v.raw", "v.truth", stage.alias("stage"))


def to_table(cells: DataFrame) -> DataFrame:
    """The judge table (F9) of VARIANT cells: one literal column per aspect."""
    wide = cells.withColumn("cell", literal("cell")).groupBy("task", "model", "prompt_id").pivot("aspect", ASPECTS).agg(F.first("cell"))
    return wide.select("task", "model", "prompt_id", *[F.col(f"`{a}`").alias(f"{a}_wo_hf") for a in ASPECTS])
