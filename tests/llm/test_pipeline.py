"""The stages against brute-force versions, one after the other, and the
registered queries against their SQL."""

import hashlib

import duckdb
import pytest
from .test_decontaminate import brute as hits
from .test_line_spread import brute as lines
from .test_mixing import brute as raked
from .test_near_duplicates import brute as groups
from .tests_llm_words import words

import corpus_pipeline
from textctl.llm import queries
from textctl.llm.mixing import Params

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "conversations")


def topic(t):
    return "legal" if "icens" in t else "tabular" if " | " in t else "contact" if "@" in t or "http" in t else "prose"


def rake(rows):
    cells = {}
    for key, n in rows:
        cells[key] = cells.get(key, 0) + n
    return {k: round(x, 6) for k, x in raked(cells, Params().targets, Params())[0].items()}


def test_pipeline_equals_brute_force(spark, texts):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {d: (t, lang, s) for d, t, lang, s in texts if any(c.isalpha() for c in t)}
    clean = lines([(d, t, s) for d, (t, _, s) in docs.items()], 10)
    docs = {d: (clean[d][0], lang, s) for d, (_, lang, s) in docs.items() if clean[d][2] == 0 or clean[d][2] < clean[d][1]}
    kept = groups([(d, t) for d, (t, _, _) in docs.items()])
    docs = {d: x for d, x in docs.items() if kept[d][2]}
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in hits([(d, t) for d, (t, _, _) in docs.items()], bench) if r[-1]}
    docs = {d: x for d, x in docs.items() if d not in bad}
    chance = rake([((s, lang, topic(t)), len(words(t))) for t, lang, s in docs.values()])
    want = {}
    for d, (t, lang, s) in docs.items():
        u = int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) / 2**52
        if u < chance[s, lang, topic(t)]:
            want[d] = (t, lang, s, len(words(t)), pytest.approx(chance[s, lang, topic(t)], abs=2e-6))
    assert {d: (r.text, r.lang, r.source, r.n_tokens, r.probability) for d, r in got.items()} == want


def test_stages_keep_columns_and_pass_odd_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, "no id here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd.withColumnsRenamed({"score": "lang_pred", "n": "n_lines"}).selectExpr("*", "1 AS n_chars")
    for start in (odd, none.selectExpr("*", "1 AS n_chars")):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns or sorted(docs.columns) == sorted(start.columns), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        ids = {r.doc_id for r in docs.collect()}
        # texts without a letter go, the copy in other case goes, the benchmark's passage goes
        assert ids == (set() if start is not odd else {3, 5, 7}) and {r.doc_id for r in last} <= ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = duckdb.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    near = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert near(df.select(*rel.columns).collect()) == near(rel.fetchall())


def test_language_stage_rejects_what_is_far_from_every_language(spark):
    """With two learnt languages, whose best score is never low."""
    rows = [(i, f"the quick brown fox jumps over the lazy dog number {'abcdefgh'[i % 8]}", "en") for i in range(40)]
    rows += [(100 + i, f"der schnelle braune Fuchs springt über den faulen Hund {'abcdefgh'[i % 8]}", "de") for i in range(40)]
    far = [(200, "Это русский текст о погоде и природе", None), (201, "これは日本語のテキストです", None), (202, "1234 !!", None), (203, None, None)]
    docs = spark.createDataFrame(rows + far, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows}
