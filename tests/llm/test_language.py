from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from textctl.llm import language
from textctl.llm.common import remainder


def grams(text, n=3):
    """Present n-grams, of words in blanks."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " "
    return {t[i : i + k] for k in range(1, n + 1) for i in range(len(t) - k + 1)}


def test_held_out_accuracy(docs, texts):
    held = remainder(F.col("doc_id"), 4) == 2
    model = language.learn(docs, ~held)
    got = {r.doc_id: r for r in language.predict(docs, model).withColumn("held", held).collect()}
    right = Counter((got[d].held, got[d].lang_pred == lang) for d, _, lang, _ in texts)
    assert right[True, True] / (right[True, True] + right[True, False]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kernel_counts_common_grams():
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en")]
    model = language.Model(rows, language.Params())
    g, mark = language.Grams(model.p), []
    for t, _ in rows:
        mark.append(set(np.flatnonzero(g(t)).tolist()))
    a, b = (grams(t) for t, _ in rows)
    assert len(mark[0] & mark[1]) == pytest.approx(len(a & b), abs=2)
    assert len(mark[0]) == pytest.approx(len(a), abs=3)
    assert model.predict([t for t, _ in rows])[0] == ["de", "en"]


def test_odd_rows(odd, none):
    model = language.learn(odd, F.lit(True))
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"en", "und"}
    by = {r.doc_id: r for r in rows}
    assert [(by[i].lang_pred, by[i].score) for i in (1, 2, 6, 8)] == [("und", 0.0)] * 4 and by[5].lang_pred == "en"
    nothing = language.learn(none, F.lit(True))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(none, model).collect() == []


def test_equals_kernel_ridge_by_definition(texts):
    """Kernel values from sets of grams, the ridge problem solved as one
    linear system in the landmarks' weights and a bias."""
    rows = [(t[:600], lang) for _, t, lang, _ in texts[:60]]
    p = language.Params(landmarks=12, ridge=1e-2)
    model = language.Model(rows, p)
    g = language.Grams(p)
    sets = [frozenset(np.flatnonzero(g(t)).tolist()) for t, _ in rows]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    langs = [lang for _, lang in rows]
    order = sorted(range(len(rows)), key=lambda i: (langs[:i].count(langs[i]), i))[:12]
    k = np.array([[kernel(a, sets[j]) for j in order] for a in sets])
    names = sorted(set(langs))
    y = np.array([[1.0 if lang == x else -1.0 for x in names] for lang in langs])
    n, m = k.shape
    # minimise |k a + b - y|**2 + ridge * n * a' k_mm a
    system = np.block([[k.T @ k + p.ridge * n * k[order], k.T @ np.ones((n, 1))], [np.ones((1, n)) @ k, np.array([[n + 1e-9]])]])
    solved = np.linalg.solve(system, np.concatenate([k.T @ y, np.ones((1, n)) @ y]))
    fresh = [t[600:1200] for _, t, _, _ in texts if len(t) > 700][:40]
    got = model.predict(fresh)
    for text, lang, score in zip(fresh, *got[:2]):
        s = frozenset(np.flatnonzero(g(text)).tolist())
        values = np.array([kernel(s, sets[j]) for j in order]) @ solved[:-1] + solved[-1]
        assert score == pytest.approx(np.clip((values.max() + 1) / 2, 0, 1), abs=1e-4)
        assert names[int(values.argmax())] == lang or sorted(values)[-1] - sorted(values)[-2] < 1e-3


def test_every_label_is_learnt(spark):
    """More labels than sample rows, one of them with long texts only; ties
    go to the label that sorts first."""
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} {chr(0x5E00 + i)}", f"l{i:03}") for i in range(30)]
    rows += [(100, "ñandú ñoño " * 5000, "long"), (200, "tie word", "tb"), (201, "tie word", "ta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True), language.Params(sample_rows=10, sample_chars=1000, landmarks=5))
    assert model.langs == sorted({r[2] for r in rows})
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 29, 100)] == ["l000", "l029", "long"]
    assert got[200].lang_pred == got[201].lang_pred and all(r.known == 1 for r in got.values() if r.doc_id != 100)
