"""Substring dedup by sliding sentence spans.

A text is cut into sentences: a sentence ends after a mark of sentence or
clause punctuation that is followed by a blank, after a full-width mark, and
at every newline. Clauses are used as sentences because passages that are
copied into other texts seldom begin and end with a sentence. A sentence of
more than ``words`` words is cut further, before the word with the smallest
hash of every ``window`` words in a row: equal words are cut alike wherever
a passage begins, so that one without any mark is found as well.

A character of a script that is written without blanks is a word of half
weight. A span is a run of at least ``sentences`` sentences with at least
``words`` words (one sentence does if it has twice as many). The words of
the shortest span from every sentence on and of the shortest one up to every
sentence are hashed, lower-cased, to 96 bits: what any longer repeated span
covers, they cover together. Spans are joined globally by hash; the span with
the smallest (id, position) is the first, and every sentence covered by any
other occurrence is removed. A repeated passage of ``2 * window + 3 * words``
words or more is found however it is cut.

Of equal spans within a batch of rows only the one with the smallest place
is sent to the global comparison; the others cannot be first, so what they
cover, merged to maximal runs, is known to go and is spread by place. A hot
span is thus a row per batch, whatever the number of its copies. The global
comparison is one shuffle of narrow rows by hash and a rank by place, which
spills and needs no table of all spans. Texts are read twice by scans and
shuffled once.

Defined results: a null text stays null, an empty one empty, both without
sentences; a text shorter than a span has none and stays as it is; of equal
rows (same id and text) all count as the first occurrence; null ids come
before others; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, _powers, mix64, text_session, word_spans

_END = re.compile(rb"(?<=[.!?;:,])[\x20\x09\x0B-\x0D]+|\n+|\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f]")


@dataclass(frozen=True)
class Params:
    sentences: int = 2
    words: int = 16
    window: int = 8


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start offset, weight (2; 1 for a character of an unspaced script) and
    64-bit hash of the words of lower-cased UTF-8 bytes."""
    raw, start, end = word_spans(data)
    if not len(start):
        return start, start, start.view(np.uint64)
    alone = raw[:0]
    if raw.max() >= 0xE0:
        after = np.append(raw[1:], 0)
        # kana and Han, full-width forms, Thai and Lao, Burmese, Khmer, Han beyond the basic plane
        alone = (raw >= 0xE3) & (raw <= 0xE9) | (raw == 0xEF) & (after >= 0xBC) & (after <= 0xBD) | (raw == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
        alone = alone | (raw == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F)) | (raw == 0xF0) & (after >= 0xA0)
    weight = np.full(len(start), 2, np.int64)
    if alone.any():
        one = np.flatnonzero(alone)
        behind = one + np.where(raw[one] == 0xF0, 4, 3)
        behind = behind[~np.isin(behind, end)]
        begins = np.unique(np.concatenate([start, one, behind[behind < len(raw)]]))
        word = np.searchsorted(start, begins, "right") - 1
        start, end = begins, np.minimum(np.append(begins[1:], len(raw)), end[word])
        weight = np.where(alone[start], 1, 2)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return start, weight, mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _smallest(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equal ones) of every
    ``window`` in a row."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (np.arange(len(rows)) + rows.argmin(1)))


def _cut(data: bytes, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the cuts between sentences (0 and the length
    included), the words before each cut, the words' weights and hashes."""
    cuts = np.unique(np.array([0, *(m.end() for m in _END.finditer(data)), len(data)], np.int64))
    begins, weight, hashes = _words(data.translate(LOWER))
    before = np.searchsorted(begins, cuts)
    weights = np.concatenate([[0], np.cumsum(weight)])
    long = np.diff(weights[before]) > 2 * p.words
    if long.any():
        places = _smallest(hashes, p.window)
        places = places[long[np.searchsorted(before, places, "right") - 1]]
        cuts = np.unique(np.concatenate([cuts, begins[places]]))
        before = np.searchsorted(begins, cuts)
    return cuts, before, weights, hashes


def sentences(data: bytes, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the sentences of UTF-8 bytes; together
    they cover all bytes (a sentence owns the blanks behind it)."""
    cuts = _cut(data, p)[0] if data else np.zeros(1, np.int64)
    return cuts[:-1], cuts[1:]


def spans(data: bytes, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence of every span, and two 64-bit hashes."""
    none = np.zeros(0, np.int64)
    if not data:
        return none, none, none, none
    _, before, weights, hashes = _cut(data, p)
    if weights[-1] < 2 * p.words:
        return none, none, none, none
    filled = np.flatnonzero(before[1:] > before[:-1])  # sentences with words
    at = np.append(before[filled], len(hashes))  # words before each of these
    w = weights[at]
    # shortest spans from each sentence on; ends are exclusive
    first = np.arange(len(filled))
    last = np.searchsorted(w, w[:-1] + 2 * p.words)
    last = np.minimum(np.maximum(last, first + p.sentences), np.searchsorted(w, w[:-1] + 4 * p.words))
    fits = last < len(at)
    # and up to each sentence
    stop = np.arange(1, len(at))
    back = np.searchsorted(w, w[1:] - 2 * p.words, "right") - 1
    back = np.maximum(np.minimum(back, stop - p.sentences), np.searchsorted(w, w[1:] - 4 * p.words, "right") - 1)
    runs = np.concatenate([first[fits] * len(at) + last[fits], (back * len(at) + stop)[back >= 0]])
    first, last = np.divmod(np.unique(runs), len(at))
    if not len(first):
        return none, none, none, none
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        up = np.cumprod(np.full(len(hashes) + 1, base, np.uint64))
        down = np.cumprod(np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ np.uint64(base)) * up[:-1])])
        one, two = at[first], at[last]
        out.append(mix64((sums[two] - sums[one]) * down[one] + (two - one).astype(np.uint64)).view(np.int64))
    return filled[first], filled[last - 1], out[0], out[1]


def _covered(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentences of some runs (ordered by ``first``) as maximal runs."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    new = np.append(True, first[1:] > reach[:-1] + 1)
    return first[new], reach[np.append(np.flatnonzero(new)[1:], len(first)) - 1]


def _batch_spans(texts: list[tuple[int, str | None]], p: Params) -> list[np.ndarray]:
    """Columns (row, first, last, h1, h2, known) of the spans of a batch of
    (row, text) in the order of their ids' ranks. ``known`` rows are the
    merged cover of spans that stand at a smaller place of the batch too; the
    others are the smallest of their kind here. Ties of place are all sent."""
    found = [spans((t or "").encode("utf-8", "surrogatepass"), p) for _, t in texts]
    number = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    first, last, h1, h2 = (np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(4))
    order = np.argsort(h1, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    again = np.zeros(len(order), bool)
    again[order] = same
    parts = [[number[~again], first[~again], last[~again], h1[~again], h2[~again]]]
    number, first, last = number[again], first[again], last[again]
    edge = np.flatnonzero(np.diff(number, prepend=-1))
    for at, to in zip(edge, np.append(edge[1:], len(number))):
        one, two = _covered(first[at:to], last[at:to])
        place = mix64(np.uint64(0x9E37) + (np.uint64(number[at]) << np.uint64(32)) + one.astype(np.uint64)).view(np.int64)
        parts.append([np.full(len(one), number[at]), one, two, place, np.zeros(len(one), np.int64)])
    columns = [np.concatenate(c) for c in zip(*parts)]
    rows = np.array([r for r, _ in texts], np.int64)
    return [rows[columns[0]], *columns[1:], np.arange(len(columns[0])) >= len(parts[0][0])]


def _span_rows(rows: DataFrame, p: Params) -> DataFrame:
    """(id, mark, first, last, h1, h2, known) of the spans of (id, mark, text).
    Of rows with equal id and mark a batch gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = pc.sort_indices(b.column(0), sort_keys=[("id", "ascending")], null_placement="at_start").to_pylist()
            ids, marks, texts = (c.to_pylist() for c in b.columns)
            alike: dict = {}
            for r in order:
                alike.setdefault((ids[r], marks[r]), r)
            # rows of one id tie: the first text at a place must not outdo another's
            turns: list[list[tuple[int, str | None]]] = []
            used: dict = {}
            for (i, _), r in alike.items():
                turn = used[i] = used.get(i, -1) + 1
                if turn == len(turns):
                    turns.append([])
                turns[turn].append((r, texts[r]))
            for turn in turns:
                row, first, last, h1, h2, known = _batch_spans(turn, p)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(h1), pa.array(h2.astype(np.int32)), pa.array(known)], ["id", "mark", "first", "last", "h1", "h2", "known"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark long, first int, last int, h1 long, h2 int, known boolean")


def _without(data: bytes, first: list[int], last: list[int], p: Params) -> tuple[int, int, list[tuple[int, int]], bytes]:
    """Sentences, removed sentences, removed byte ranges, what stays."""
    start, end = sentences(data, p)
    gone = np.zeros(len(start) + 1, np.int64)
    np.add.at(gone, np.array(first, np.int64), 1)
    np.add.at(gone, np.array(last, np.int64) + 1, -1)
    gone = np.cumsum(gone)[:-1] > 0
    edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
    ranges = [(int(start[a]), int(end[b - 1])) for a, b in zip(edge[0::2], edge[1::2])]
    parts, at = [], 0
    for a, b in ranges:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return len(start), int(gone.sum()), ranges, b"".join(parts)


def without_repeats(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of its columns), ``clean`` (the
    text without removed sentences), ``n_sentences``, ``n_removed`` and
    ``removed`` (character ranges of the original text, ends exclusive)."""
    text_session(docs.sparkSession)
    mark = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    same = Window.partitionBy("h1", "h2", "known").orderBy(F.col("id").asc_nulls_first(), "first")
    again = _span_rows(rows, p).withColumn("place", F.rank().over(same)).filter(F.col("known") | (F.col("place") > 1))
    covered = again.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("__covered"))
    covered = covered.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("__covered.first").alias("__first"), F.col("__covered.last").alias("__last"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), mark.alias("mark"))
    whole = whole.join(covered, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left").select("row", F.col("row").getField(text_col).alias("text"), "__first", "__last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, first, last in zip(*(c.to_pylist() for c in b.columns[1:])):
                data = (text or "").encode("utf-8", "surrogatepass")
                n, m, ranges, stays = _without(data, first or [], last or [], p)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]) if ranges else None
                out.append((None if text is None else stays.decode("utf-8", "surrogatepass"), n, m, [{"start": int(chars[x]), "end": int(chars[y])} for x, y in ranges]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["row", "clean", "n_sentences", "n_removed", "removed"])

    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, clean string, n_sentences long, n_removed long, removed array<struct<start:int,end:int>>")
