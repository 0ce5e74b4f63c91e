"""From raw documents to a training mix: five stages, each calling one of the
operators in ``textctl/llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
``run`` writes as Parquet to the shared folder and reads again for the next
one. All but the last return the columns of ``docs``; the last adds
``n_tokens`` and ``probability``. Rows keep their columns, known or not.
Empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textctl.llm import decontaminate, language, line_spread, mixing, near_duplicates
from textctl.llm.common import remainder, saved, table

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those far
    from every learnt language (``known`` under the model's ``floor``: other
    scripts, noise), go. Equal texts are decided alike; repeated
    rows and rows without an id stay."""
    model = language.learn(docs, remainder(F.col("doc_id"), 4) != 2)
    names = {"lang_pred": "__l", "score": "__s", "known": "__k"}
    scored = language.predict(docs.withColumnsRenamed(names), model)
    kept = scored.filter((F.col("lang_pred") != language.UND) & (F.col("known") >= model.floor))
    return kept.drop(*names).withColumnsRenamed({v: k for k, v in names.items()})


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across sites are removed but for their first
    occurrence; a document left without a line goes, one without lines from
    the start (null, empty) stays. Ties between occurrences go to the smaller
    id and line. ``n_chars`` follows the text."""
    names = {"n_lines": "__n_lines", "n_removed": "__n_removed"}
    clean = line_spread.without_boilerplate(docs.withColumnsRenamed(names))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    clean = clean.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    clean = clean.withColumn("n_chars", n_chars) if n_chars is not None else clean
    return clean.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in names.items()})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id.
    Rows of one id are one document; null and wordless texts, and rows without
    an id, stay."""
    found = near_duplicates.near_duplicates(docs)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null texts have none."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("spans") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of source, language and topic;
    rows of one id share their fate, texts without words have probability 0
    where their whole cell has none."""
    return mixing.mixed(docs).filter("kept").drop("kept")


STAGES = [
    ("language", identify_language),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mix", mix),
]

#: The language and near-duplicate stages are beyond SQL; tests hold ``run``
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
