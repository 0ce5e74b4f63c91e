import random

import pytest

from textctl.llm.token_counts import PATTERN, RULES, Encoder, attribute, line_sections, token_counts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def brute(start, end, sections, rule):
    out = []
    for _, a, b in sections:
        n = crossing = 0
        for s, e in zip(start.tolist(), end.tolist()):
            last = max(e - 1, 0)
            first = min(s, last)
            if a >= b:
                continue
            if rule == "share":
                n += max(0, min(last + 1, b) - max(first, a)) / (last + 1 - first)
            else:
                n += a <= (first if rule == "start" else last) < b
            crossing += first < b and last >= a and not (first >= a and last < b)
        out.append((pytest.approx(n, abs=1e-6), crossing))
    return out


def test_attribution_equals_brute_force(texts):
    encoder, rng = Encoder(open(RANKS, "rb").read(), PATTERN), random.Random(1)
    for text in [t for _, t, _, _ in texts if len(t) < 1500][:40] + ["日本語 テキスト 😀😀 é\n\n x", "a", "\n", "👩‍👩‍👧 ok"]:
        start, end = encoder.spans(text)
        lines = line_sections(text)
        assert "".join(text[a:b] for _, a, b in lines) == text
        cuts = [("s", *sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))) for _ in range(5)]
        for rule in RULES:
            for sections in (lines, cuts):
                assert list(zip(*attribute(start, end, sections, rule))) == brute(start, end, sections, rule)
            assert attribute(start, end, lines, rule)[0].sum() == pytest.approx(len(start))


def test_spans_equal_another_library(texts):
    from tokenizers import Tokenizer

    encoder = Encoder(open(RANKS, "rb").read(), PATTERN)
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for _, text, _, _ in texts:
        start, end = encoder.spans(text)
        offsets = other.encode(text, add_special_tokens=False).offsets
        assert len(offsets) == len(start)
        if text.isascii():
            assert offsets == list(zip(start.tolist(), end.tolist()))


def test_table_of_sections_equals_function(spark, docs, texts):
    rows = [(d, *s) for d, t, _, _ in texts for s in line_sections(t)]
    sections = spark.createDataFrame(rows, "doc_id long, section string, start long, end long")
    assert sorted(token_counts(docs, RANKS, sections).collect()) == sorted(token_counts(docs, RANKS).collect())


def test_odd_rows(odd, none):
    rows = token_counts(odd, RANKS).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.section, r.n_tokens, r.doc_tokens) for r in by[1] + by[2]] == [(None, 0.0, 0)] * 2
    assert len(by[7]) == 2 and len(by[6]) == 2 and by[5][0].doc_tokens > 60_000
    for r in by.values():
        assert sum(x.n_tokens for x in r) == r[0].doc_tokens * (2 if r[0].doc_id == 7 else 1)
    assert token_counts(none, RANKS).collect() == []
    with pytest.raises(ValueError):
        token_counts(none, RANKS, rule="other")
