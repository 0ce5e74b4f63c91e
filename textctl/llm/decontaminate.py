"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark texts and documents are normalised to words (A-Z lower-cased;
words are runs of digits, letters a-z and non-ASCII characters). Every
window of ``window`` consecutive words of an item is a pattern; an item of
fewer words, but not none, is one pattern. The alphabet of the automaton is
the benchmark's words: a document is looked up word by word, words unknown
to the benchmark become a symbol that no pattern has, and one pass over the
symbols finds every occurrence of every pattern. Hits are mapped back to
character offsets of the original text.

The automaton's size follows the benchmark's, which is measured before it is
sent: up to ``block_bytes`` of text go into one automaton; a larger
benchmark is cut into blocks of items, each scanned against all documents,
and the hits are merged per document.

Defined results: null and empty texts have no words and no hits; null or
wordless items have no patterns; an item with a null id marks words but is
not listed; equal items are each listed; repeated documents are rows of
their own; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, text_session

WINDOW = 10
BLOCK_BYTES = 2 << 20
# bytes of UTF-8: word bytes are lower-cased, all others become a space
_WORDS = bytes(LOWER[b] if chr(LOWER[b]).isdigit() and b < 128 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = "array<struct<start:int,end:int,first_word:int,last_word:int>>"
_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "first_word", "last_word")]))


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


class Patterns:
    """The automaton of a block of ``(item_id, text)`` rows."""

    def __init__(self, items: list, window: int):
        self.symbols: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for number, (_, text) in enumerate(items):
            w = tuple(self.symbols.setdefault(x, len(self.symbols) + 1) for x in words((text or "").encode("utf-8", "surrogatepass")))
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                found.setdefault(w[i : i + n], set()).add(number)
        self.ids = [i for i, _ in items]
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, numbers in found.items():
                self.automaton.add_word(key, (len(key), tuple(numbers)))
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list, list]:
        """Number of words, merged hit spans, ids of the items that occur."""
        data = (text or "").encode("utf-8", "surrogatepass")
        w = words(data)
        if not w or self.automaton is None:
            return len(w), [], []
        get = self.symbols.get
        runs, numbers = [], set()
        for end, (n, items) in self.automaton.iter(tuple([get(x, 0) for x in w])):
            runs.append((end - n + 1, end))
            numbers.update(items)
        if not runs:
            return len(w), [], []
        ids = {self.ids[i] for i in numbers} - {None}
        return len(w), _with_offsets(data, merged(runs)), sorted(ids)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of runs of words, both ends included."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _with_offsets(data: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    raw = np.frombuffer(data, np.uint8)
    inside = (np.frombuffer(data.translate(_WORDS), np.uint8) != 32).view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    start, end = chars[edge[0::2]], chars[edge[1::2]]
    return [{"start": int(start[a]), "end": int(end[b]), "first_word": a, "last_word": b} for a, b in runs]


_BUILT: dict = {}


def _patterns(block, window: int) -> Patterns:
    """Built once per Python worker."""
    key = (block.value[0], window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Patterns(block.value[1], window)
    return _BUILT[key]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of its columns), ``n_words``,
    ``spans`` (merged runs of hit words with character offsets into the
    original text, ends exclusive, and word numbers, ends inclusive) and
    ``items`` (ids of occurring items)."""
    spark = docs.sparkSession
    text_session(spark)
    items = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    item_type = items.schema["item"].dataType
    hits = f"n_words long, spans {_SPANS}, items array<{item_type.simpleString()}>"
    arrow = [pa.int64(), _ARROW_SPANS, pa.list_(to_arrow_type(item_type))]

    def scan(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = None
            for b in batches:
                patterns = patterns or _patterns(block, window)
                out = list(zip(*map(patterns.scan, b.column(b.num_columns - 1).to_pylist()))) or [[], [], []]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(out, arrow))], [*b.schema.names[:-1], "n_words", "spans", "items"])

        return run

    def block_of(n: int):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == n)
        return spark.sparkContext.broadcast((uuid4().hex, [(r["item"], r["text"]) for r in part.collect()]))

    if n_blocks == 1:
        return rows.mapInArrow(scan(block_of(0)), f"row {rows.schema['row'].dataType.simpleString()}, {hits}")

    # equal texts have equal hits: each block is scanned against (digest, text)
    rows = rows.withColumn("digest", F.sha2("text", 256))
    parts = [rows.select("digest", "text").mapInArrow(scan(block_of(n)), f"digest string, {hits}") for n in range(n_blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("digest").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans")), lambda x, y: F.coalesce(F.nullif(F.signum(x["first_word"] - y["first_word"]), F.lit(0.0)), F.signum(x["last_word"] - y["last_word"])).cast("int")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # union of the blocks' runs: a run that begins inside or right after the last one widens it
    joined = F.aggregate(
        "spans",
        F.array().cast(_SPANS),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["first_word"] <= F.element_at(acc, F.when(F.size(acc) > 0, F.lit(-1)).otherwise(F.lit(None)))["last_word"] + 1),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(_wider(F.element_at(acc, F.when(F.size(acc) > 0, F.lit(-1)).otherwise(F.lit(None))), s)),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    found = found.withColumn("spans", joined)
    found = found.withColumnRenamed("digest", "found")
    return rows.join(found, F.col("digest").eqNullSafe(F.col("found")), "left").select("row", "n_words", "spans", "items")


def _wider(a, b):
    later = a["last_word"] >= b["last_word"]
    return F.struct(
        a["start"].alias("start"),
        F.when(later, a["end"]).otherwise(b["end"]).alias("end"),
        a["first_word"].alias("first_word"),
        F.greatest(a["last_word"], b["last_word"]).alias("last_word"),
    )


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of ``contamination``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last_word"] - s["first_word"] + 1))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("row")[id_col].alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
