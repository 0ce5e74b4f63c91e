"""Token counts by offset-mapped attribution.

Every document is encoded once, whole, with a public tokenizer's byte-pair
ranks; a token's span in characters follows from the byte lengths of the
tokens. Token spans are joined to the document's sections as intervals (two
sorted lists, binary searches), and a token that crosses a section boundary
is allocated by a rule:

- ``start``: to each section that holds its first character;
- ``end``: to each section that holds its last character;
- ``share``: to every section it touches, in proportion to its characters.

With sections that partition the text, each rule's counts add up to the
document's tokens. Overlapping sections (nested fields) are counted each on
its own.

A character belongs to the token in which its first byte lies; a token of
continuation bytes only has the span of the character it continues, from its
end, and is allocated with its last character under every rule.

Defined results: a null or empty text has no tokens; a document without
sections is one row with a null section and its number of tokens; sections
are cut to the text; empty sections have no tokens; equal rows are rows of
their own; other columns are ignored.

The vocabulary (``path``, about a megabyte; at most ``MAX_VOCABULARY``
bytes) is read on the driver and broadcast, so that executors need no file.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_session

MAX_VOCABULARY = 64 << 20
#: The usual split of text before byte-pair merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "share")

Sections = list[tuple[str, int, int]]


def line_sections(text: str) -> Sections:
    """Lines, each with the newline behind it: a partition of the text."""
    out, at = [], 0
    for line in text.split("\n"):
        if end := min(at + len(line) + 1, len(text)) - at:
            out.append((f"line {len(out)}", at, at + end))
        at += len(line) + 1
    return out


class Encoder:
    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, n in table.items():
            self.size[n] = len(token)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token, in characters."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        end = np.cumsum(self.size[ids])
        start = end - self.size[ids]
        if text.isascii():
            return start, end
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        # characters that begin before each byte
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return before[start], before[end]


def attribute(start: np.ndarray, end: np.ndarray, sections: Sections, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per section: its tokens by the rule, and the tokens that cross one of
    its boundaries."""
    low = np.array([s[1] for s in sections], np.int64)
    high = np.maximum(np.array([s[2] for s in sections], np.int64), low)
    last = np.maximum(end - 1, 0)  # the last character
    first = np.minimum(start, last)  # of a token of continuation bytes: the same
    if rule == "start":
        count = (np.searchsorted(first, high) - np.searchsorted(first, low)).astype(float)
    elif rule == "end":
        count = (np.searchsorted(last, high) - np.searchsorted(last, low)).astype(float)
    else:
        # tokens up to a place, the one that holds it in part
        edges = np.concatenate([low, high])
        i = np.searchsorted(last + 1, edges, side="right")  # whole tokens before the edge
        at = np.minimum(i, max(len(first) - 1, 0))
        part = np.where(i < len(first), np.clip((edges - first[at]) / (last[at] + 1 - first[at]), 0, 1), 0) if len(first) else np.zeros(len(edges))
        upto = i + part
        count = upto[len(low) :] - upto[: len(low)]
    touched = np.searchsorted(first, high) - np.searchsorted(last, low)
    whole = np.searchsorted(last, high) - np.searchsorted(first, low)
    crossing = np.where(high > low, np.maximum(touched - np.maximum(whole, 0), 0), 0)
    return np.where(high > low, count, 0), crossing


_BUILT: dict = {}


def _encoder(sent) -> Encoder:
    """Built once per Python worker."""
    key, ranks, pattern = sent.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(ranks, pattern)
    return _BUILT[key]


def token_counts(
    docs: DataFrame,
    path: str,
    sections: DataFrame | Callable[[str], Sections] = line_sections,
    rule: str = "start",
    pattern: str = PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and section: the id, ``section``, ``start``,
    ``end`` (characters), ``n_tokens``, ``n_crossing`` and ``doc_tokens``.

    ``sections`` is a function of the text, or a table of ``id_col``,
    ``section``, ``start`` and ``end``; a table is gathered per document (a
    document's own sections only) and joined by id.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    text_session(spark)
    ranks = open(path, "rb").read()
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError("the vocabulary is too large to broadcast")
    sent = spark.sparkContext.broadcast((uuid4().hex, ranks, pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    given = isinstance(sections, DataFrame)
    cut = None if given else sections  # what the tasks need
    if given:
        own = sections.filter("start IS NOT NULL AND end IS NOT NULL").groupBy(F.col(id_col).alias("__id"))
        own = own.agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("section").cast("string").alias("section")))).alias("sections"))
        rows = rows.join(own, F.col("id") == F.col("__id"), "left").select("id", "text", "sections")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or _encoder(sent)
            row, out, counts, crossings = [], [], [], []
            tables = b.column(2).to_pylist() if given else None
            for i, text in enumerate(b.column(1).to_pylist()):
                text = text or ""
                start, end = encoder.spans(text)
                parts = [(s["section"], s["start"], s["end"]) for s in tables[i] or []] if given else cut(text)
                parts = [(name, max(0, min(x, len(text))), max(0, min(y, len(text)))) for name, x, y in parts]
                if parts:
                    count, crossing = attribute(start, end, parts, rule)
                else:
                    parts, count, crossing = [(None, None, None)], [float(len(start))], [0]
                row.extend([i] * len(parts))
                out.extend((*p, len(start)) for p in parts)
                counts.extend(count)
                crossings.extend(crossing)
            name, x, y, total = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossings, pa.int64()), pa.array(total, pa.int64())],
                ["id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, section string, start long, end long, n_tokens double, n_crossing long, doc_tokens long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
