"""Language identification by a string kernel.

The kernel of two texts is the number of n-grams, n from 1 to ``grams``,
present in both (blended spectrum, presence), divided by the geometric mean
of their own numbers. Texts are lower-cased code points with every run of
non-letters as one blank. Grams are hashed to ``2**bits`` numbers.

Learning takes a bounded sample: ``sample_rows`` labelled rows in equal
parts for all labels, but at least one of each, chosen by a hash of the id;
of a text longer than ``sample_chars`` code points the sample holds a piece
of that length, at a place given by the hash. ``landmarks`` of them, at least
one of each label, span a Nyström approximation of the kernel;
one-versus-rest ridge regression in that space gives one weight per landmark
and language, so a text is scored by its kernel values with the landmarks: a
matrix product per batch. Prediction reads whole texts and nothing else.
Labels are languages: their number, not that of the rows, bounds what the
driver counts.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text if no labelled row can be learnt from. Equal texts get
equal predictions. Other columns are ignored. The score is the best
regression value, brought from [-1, 1] to [0, 1]; under 0.5 no
language's classifier claims the text. With few languages even the best of
them is never low, so ``known`` says, whatever their number, which part of a
text's grams any landmark has. ``Model.floor`` is a bound for it that the
sample itself gives: half the value that 95 % of the sample rows reach
against the other rows' landmarks, so 0 where there is too little to compare.
Ties go to the label that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_session

UND = "und"


@dataclass(frozen=True)
class Params:
    grams: int = 3
    bits: int = 18
    sample_rows: int = 800
    sample_chars: int = 20_000
    landmarks: int = 96
    ridge: float = 1e-3


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to lower-cased code point, 32 for what is no letter."""
    if not _LETTERS:
        low = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low[c] = ord(chr(c).lower()[0])
        _LETTERS.append(low)
    return _LETTERS[0]


class Grams:
    """Marks the grams that are present in a text."""

    def __init__(self, p: Params):
        self.p = p
        self.mark = np.zeros(1 << p.bits, bool)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """A view that the next call overwrites; None without a letter."""
        if not text:
            return None
        code = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        code = np.concatenate([[np.uint32(32)], code, [np.uint32(32)]])
        blank = code == 32
        code = code[1:][~(blank[1:] & blank[:-1])]
        if len(code) < 2:
            return None
        code = np.concatenate([[np.uint32(32)], code])
        self.mark[:] = False
        gram = code
        for n in range(1, self.p.grams + 1):
            if n > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + code[n - 1 :]
            x = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            self.mark[x >> np.uint32(32 - self.p.bits)] = True
        return self.mark


class Model:
    """Landmarks, their grams and a weight per landmark and language."""

    def __init__(self, rows: list[tuple[str, str]], p: Params):
        self.p = p
        grams = Grams(p)
        marks, langs = [], []
        for text, lang in rows:
            m = grams(text)
            if m is not None:
                marks.append(np.flatnonzero(m))
                langs.append(lang)
        self.langs = sorted(set(langs))
        self.floor = 0.0
        if not self.langs:
            return
        # landmarks in turn from every language
        turns = np.array([langs[:i].count(x) for i, x in enumerate(langs)])
        marked = np.lexsort((np.arange(len(langs)), turns))[: max(p.landmarks, len(self.langs))]
        self.ids = np.unique(np.concatenate([marks[i] for i in marked]))
        self.table = np.zeros((len(self.ids), len(marked)), np.float32)
        for j, i in enumerate(marked):
            self.table[np.searchsorted(self.ids, marks[i]), j] = 1
        self.own = np.sqrt(self.table.sum(axis=0, dtype=np.float64))
        present = np.zeros((len(marks), len(self.ids)), np.float32)
        for i, m in enumerate(marks):
            at = np.searchsorted(self.ids, m)
            at = np.minimum(at, len(self.ids) - 1)
            present[i, at[self.ids[at] == m]] = 1
        others = np.tile(self.table.sum(axis=1), (len(marks), 1))
        others[marked] -= present[marked]
        self.floor = float(np.percentile((present * (others > 0)).sum(axis=1) / [len(m) for m in marks], 5)) / 2
        k = self.kernel(present, np.array([len(m) for m in marks]))
        values, vectors = np.linalg.eigh(k[marked])
        keep = values > 1e-6 * values[-1]
        to_space = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.concatenate([k @ to_space, np.ones((len(k), 1))], axis=1)
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        penalty = np.eye(phi.shape[1]) * p.ridge * len(k)
        penalty[-1, -1] = 1e-9
        w = np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
        self.weights, self.bias = to_space @ w[:-1], w[-1]

    def kernel(self, present: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (present @ self.table).astype(np.float64) / (np.sqrt(size)[:, None] * self.own[None, :])

    def predict(self, texts: list[str | None], block: int = 256) -> tuple[list[str], list[float], list[float]]:
        grams = Grams(self.p)
        langs, scores, known = [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores, known
        for at in range(0, len(texts), block):
            rows, size, present = [], [], []
            for i, text in enumerate(texts[at : at + block], at):
                m = grams(text)
                if m is not None:
                    rows.append(i)
                    size.append(np.count_nonzero(m))
                    present.append(m[self.ids])
            if rows:
                marked, size = np.array(present, np.float32), np.array(size)
                y = self.kernel(marked, size) @ self.weights + self.bias
                for i, lang, value, part in zip(rows, y.argmax(axis=1), np.clip((y.max(axis=1) + 1) / 2, 0, 1), marked.sum(axis=1) / size):
                    langs[i], scores[i], known[i] = self.langs[lang], float(value), float(part)
        return langs, scores, known


def learn(docs: DataFrame, learnable: Column, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on a bounded sample of the rows where ``learnable``."""
    rows = docs.filter(learnable).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Model([], p)
    each = max(1, p.sample_rows // len(counts))
    # about four times as many rows as are taken, by a hash of the id; the first of these by that hash
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 30))
    place = hashed / float(1 << 30)
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (4 * each + 16) / r["count"])))])
    some = rows.withColumn("place", place).filter(F.col("place") < rate[F.col("lang")])
    some = some.filter(F.col("text") != "")
    more = F.greatest(F.length("text") - p.sample_chars, F.lit(0))
    some = some.withColumn("text", F.substring("text", (F.pmod(hashed, more + 1) + 1).cast("int"), F.lit(p.sample_chars)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text"))
    taken = some.withColumn("nr", first).filter(F.col("nr") <= each).select("lang", "text", "nr").collect()
    return Model([(r["text"], r["lang"]) for r in sorted(taken, key=lambda r: (r["lang"], r["nr"]))], p)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` and ``known``
    added; columns of these names are replaced."""
    spark = docs.sparkSession
    text_session(spark)
    docs = docs.drop("lang_pred", "score", "known")
    at = docs.columns.index(text_col)
    # a few megabytes: grams of at most ``landmarks`` texts
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, known = sent.value.predict(b.column(at).to_pylist())
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "lang_pred", "score", "known"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("known", DoubleType())])
    return docs.mapInArrow(run, schema)
