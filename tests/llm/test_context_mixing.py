import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from .tests_llm_words import words

from pyspark.sql import functions as F

from textctl.llm import context_mixing as cm
from textctl.llm.common import remainder

SMALL = replace(cm.Params(), bits=(18, 18, 18))


def test_base_equals_brute_force_and_the_model_learns(docs, texts):
    got = {r.doc_id: r for r in cm.score(docs, remainder(F.col("doc_id"), 10) == 0, replace(SMALL, block_tokens=5000)).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _, _, _ in texts}
    tokens = {d: words(t) + ["\0end"] for d, t, _, _ in texts}
    c = Counter(x for d, w in tokens.items() if not held[d] for x in w)
    total = sum(c.values())
    for d, w in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes)
    rate = {h: sum(r.bits_per_byte * r.n_bytes for r in rows) / sum(r.n_bytes for r in rows) for h in (True, False) if (rows := [r for r in got.values() if r.held_out == h])}
    # single bytes have 4.5 bits; texts that were learnt from are known better
    assert rate[False] < rate[True] < 2.7


def test_probabilities_sum_to_one():
    """Over all texts of one byte (as the coder sees them), with counts."""
    code = cm.Code(np.arange(1 << 16))
    into = [np.zeros(2 << b, np.uint32) for b in SMALL.bits]
    cm.counts(code, [b"some words to count\n", b"others\n"], SMALL.bits, into)
    tables = [cm._logits(x[1::2].astype(float), (x[0::2] + x[1::2]).astype(float), SMALL.prior) for x in into]
    logs = cm.Scorer(code, tables, SMALL)([bytes([b]) for b in range(256)])
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_scores_depend_on_the_text_alone(texts):
    data = [cm.normalised(t) for _, t, _, _ in texts[:60]] + [cm.normalised(None), cm.normalised("x " * 50_000)]
    pairs = np.frombuffer(b"\0" + b"\0".join(data), np.uint8).astype(int)
    code = cm.Code(np.bincount(pairs[:-1] * 256 + pairs[1:], minlength=1 << 16))
    into = [np.zeros(2 << b, np.uint32) for b in SMALL.bits]
    cm.counts(code, data[:40], SMALL.bits, into)
    tables = [cm._logits(x[1::2].astype(float), (x[0::2] + x[1::2]).astype(float), SMALL.prior) for x in into]
    scorer = cm.Scorer(code, tables, SMALL)
    together = scorer(data)
    alone = np.array([scorer([t])[0] for t in data])
    assert np.allclose(together, alone, rtol=1e-5)
    # a repetitive text is learnt while it is read
    assert -together[-1] / math.log(2) / len(data[-1]) < 0.3


def test_odd_rows(odd, none):
    rows = cm.score(odd, remainder(F.col("doc_id"), 10) == 0, SMALL).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[6].n_tokens == 1 and by[1].score == by[2].score
    assert by[3].score == pytest.approx(by[4].score) and by[5].n_tokens == 120_001
    assert cm.score(none, F.lit(False), SMALL).collect() == []
    held = cm.score(odd, F.lit(True), SMALL).collect()
    assert {(r.train_tokens, r.n_known) for r in held} == {(0, 0)}


def test_contexts_do_not_share_counts(docs):
    """What is gathered grows with the texts: a table's size has no say."""
    some = docs.filter("doc_id < 60")
    one, two = ({r.doc_id: r.score for r in cm.score(some, remainder(F.col("doc_id"), 10) == 0, replace(cm.Params(), bits=(b, b, b), block_bytes=size, piece_bytes=piece)).collect()} for b, size, piece in ((17, 20_000, 10_000), (22, 1 << 23, 1 << 22)))
    assert one.keys() == two.keys() and len(one) > 0
    for d, score in one.items():
        assert score == pytest.approx(two[d], rel=1e-5)


def test_logits_equal_brute_force():
    texts = [b"some words to count\n", b"others to count, some more\n"]
    code = cm.Code(np.arange(1 << 16))
    asked = cm.Asked([texts], 3)
    keys, order = np.unique(asked.keys, return_index=True)
    assert len(keys) == len(asked.keys)
    logits, begin = cm._paths_logits(code, keys, asked.learnt(np.ones(sum(map(len, texts)), bool))[order], 0.05)
    found = Counter()
    for k, order in enumerate((2, 4, 5)):
        for t in texts:
            padded = b"\0" * 8 + t
            for i in range(8, len(padded)):
                pair = padded[i - 1] << 8 | padded[i]
                for x in range(code.offset[pair], code.offset[pair] + code.length[pair]):
                    found[k, padded[i - order : i], code.node[x], code.turn[x]] += 1
    for key, at in zip(keys.tolist(), begin):
        k, pair = key >> 48, key & 0xFFFF
        context = (key >> 8 & (1 << 40) - 1).to_bytes(5, "little")[: (2, 4, 5)[k]][::-1]
        for j, x in enumerate(range(code.offset[pair], code.offset[pair] + code.length[pair])):
            zero, one = (found[k, context, code.node[x], turn] for turn in (0, 1))
            assert logits[at + j] / cm._UNIT == pytest.approx(math.log((one + 0.05) / (zero + 0.05)), abs=1 / cm._UNIT)


def test_a_task_that_runs_again_sends_the_same_rows(docs):
    """What is dealt by block and piece is read from a saved table; the key of
    the exchange is no new random number."""
    p = replace(cm.Params(), block_bytes=20_000)
    rows = docs.filter("doc_id < 60").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("mark"), F.lit(False).alias("held"), "text")
    asked = cm.saved(cm._asked(rows, 5, p), "asked", by="kind")
    code = docs.sparkSession.sparkContext.broadcast(cm.Code(np.arange(1 << 16)))
    one, two = (sorted((r.block, r.part, bytes(r.payload)) for r in cm._answers(asked, code, p).collect()) for _ in range(2))
    assert one == two and len(one) == asked.filter("kind = 1").count() > 5


def test_words_are_asked_for_by_piece(docs, texts):
    """A block's words are a row for each piece, not for each word, and come
    back with the counts of all blocks."""
    rows = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("held"), "text")
    asked = cm.saved(cm._asked(rows, 8, replace(cm.Params(), block_bytes=100_000)), "asked", by="kind")
    sent = asked.filter("kind = 2").collect()
    blocks = {r.block for r in sent}
    assert len(blocks) > 1 and len(sent) == len({(r.block, r.part) for r in sent}) <= 2 * len(blocks)
    known = Counter(x for d, t, _, _ in texts if d % 3 for x in cm._token_hashes(cm.normalised(t)).tolist())
    keys = {(r.block, r.part): np.cumsum(cm._unpacked(r.payload, np.uint64), dtype=np.uint64).tolist() for r in sent}
    answers = cm._word_counts(asked).collect()
    assert {(r.block, r.part) for r in answers} == keys.keys()
    for r in answers:
        assert cm._unpacked(r.payload, np.uint64).tolist() == [known[x] for x in keys[r.block, r.part]]
    assert (sum(r.total for r in answers), sum(r.known for r in answers)) == (sum(known.values()), len(known))
    moved = sum(len(r.payload) + len(r.learnt) for r in sent) + sum(len(r.payload) for r in answers)
    assert moved < 12 * sum(map(len, keys.values()))


def test_a_block_looks_up_each_byte_once(texts, monkeypatch):
    """A byte's keys of all predictors follow from its gram: only one look-up
    has a row for each byte, the others one for each distinct gram."""
    data = [cm.normalised(t) for _, t, _, _ in texts[:60]]
    train = np.arange(len(data)) % 3 > 0
    rows, factorize = [], cm.pd.factorize
    monkeypatch.setattr(cm.pd, "factorize", lambda x: rows.append(len(x)) or factorize(x))
    asked = cm.Asked([data[:20], data[20:]], 5)
    n = sum(map(len, data))
    assert len(rows) == 4 and rows[0] == n and sum(rows) < 2.5 * n
    found = Counter()
    for t, learnt in zip(data, train):
        padded = b"\0" * 8 + t
        for i in range(8, len(padded)):
            for k, order in enumerate((2, 4, 5)):
                found[k << 48 | int.from_bytes(padded[i - order : i + 1], "big")] += int(learnt)
    counts = asked.learnt(np.repeat(train, [len(t) for t in data]))
    assert dict(zip(asked.keys.tolist(), counts.tolist())) == found and len(asked.keys) == len(found)


def test_paths_are_found_without_hashing_each_step(texts, monkeypatch):
    """Steps are several times the keys, so no hash table has a row for each;
    contexts are worked on some at a time, here three."""
    code = cm.Code(np.arange(1 << 16) % 251)
    keys = cm.Asked([[cm.normalised(t) for _, t, _, _ in texts[:10]]], 5).keys
    monkeypatch.setattr(cm, "_TOGETHER", 3, raising=False)
    monkeypatch.delattr(cm.pd, "factorize")
    begin, which, first = cm._decisions(code, keys)
    found, steps = {}, []
    for key, at in zip(keys.tolist(), begin.tolist()):
        assert at == len(steps)
        pair = key & 0xFFFF
        steps += [found.setdefault((key >> 8, code.node[x]), len(found)) for x in range(code.offset[pair], code.offset[pair] + code.length[pair])]
    assert which.tolist() == steps and len(found) < len(steps)
    assert first.tolist() == sorted({i: at for at, i in reversed(list(enumerate(steps)))}.values())


def _answer(code, asked, n):
    """The logits of a block's decisions, for keys that occur ``n`` times."""
    keys, order = np.unique(asked.keys, return_index=True)
    logits, begin = cm._paths_logits(code, keys, n[order], 0.05)
    path, _, first = cm._decisions(code, asked.keys)
    key = np.searchsorted(path, first, "right") - 1
    return logits.take(begin[np.searchsorted(keys, asked.keys)].take(key) + first - path.take(key))


def test_gathered_probabilities_sum_to_one():
    code = cm.Code(np.arange(1 << 16))
    data = [bytes([b]) for b in range(256)]
    asked = cm.Asked([data], 3)
    answer = _answer(code, asked, np.random.default_rng(1).integers(0, 50, len(asked.keys)))
    logs = cm._scored(data, *asked.spans(code, answer), code, SMALL)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_gathered_scores_depend_on_the_text_alone(texts, monkeypatch):
    code = cm.Code(np.arange(1 << 16))
    data = [cm.normalised(t) for _, t, _, _ in texts[:40]] + [cm.normalised(None), cm.normalised("x " * 5_000)]
    asked = cm.Asked([data], 3)
    block = asked.spans(code, _answer(code, asked, asked.learnt(np.ones(sum(map(len, data)), bool))))
    together = cm._scored(data, *block, code, SMALL)
    monkeypatch.setattr(cm, "_SCORED_BYTES", 1)
    assert np.allclose(together, cm._scored(data, *block, code, SMALL), rtol=1e-5)
