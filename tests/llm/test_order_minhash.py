import hashlib
from collections import Counter

import numpy as np

from textctl.llm.common import mix64
from textctl.llm.order_minhash import Params, Sketcher, as_text, edit, edited_likeness, fingerprints, likeness


def brute(s, text):
    """Selection over all elements for each order, one element at a time."""
    if not text:
        return np.zeros(0, np.uint32)
    h = s.kmers([text])[0]
    seen, g = Counter(), []
    for v in h.tolist():
        x = np.array([v], np.uint64)
        if seen[v]:
            x = mix64(x + np.array([seen[v]], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        g.append(int(x[0] >> np.uint64(32)))
        seen[v] += 1
    g, out = np.array(g, np.uint32), []
    for i in range(s.p.size):
        pick = np.sort(np.argsort(s.mul[i] * g, kind="stable")[: s.p.tuple_size])
        code = np.array([min(s.p.tuple_size, len(h))], np.uint64)
        for j in range(s.p.tuple_size):
            code = code + h[pick[min(j, len(pick) - 1)]] * s.tuple_mul[j : j + 1]
        out.append((mix64(code) >> np.uint64(32)).astype(np.uint32)[0])
    return np.array(out)


def test_sketches_equal_brute_force(texts):
    s = Sketcher(Params())
    some = ["", "a", "ab", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "日本語のテキスト" * 3, *[t for _, t, _, _ in texts[:40]]]
    for text, sketch in zip(some, s(some)):
        assert (brute(s, text) == sketch).all()


def test_likeness_falls_with_edits_and_sees_order():
    s = Sketcher(Params(size=256))
    words = [f"word{i}" for i in range(400)]
    base, moved = " ".join(words), " ".join(words[200:] + words[:200])
    few = " ".join("xx" if i % 40 == 0 else w for i, w in enumerate(words))
    many = " ".join("xx" if i % 6 == 0 else w for i, w in enumerate(words))
    one, two, three, four, other = s([base, few, many, moved, " ".join(f"else{i}" for i in range(400))])
    assert likeness(one, one) == 1 > likeness(one, two) > likeness(one, three) > likeness(one, other)
    # the same k-mers in another order are less alike than a set sketch would say
    assert likeness(one, four) < 0.8


def test_edited_likeness_equals_brute_force(spark, docs, texts):
    s = Sketcher(Params())
    rows = sorted(texts, key=lambda r: -r[0])
    got = {r.doc_id: r for r in edited_likeness(docs).collect()}
    assert len(got) == len(rows)
    sketches = s([t for _, t, _, _ in rows])
    for i, (doc, text, _, _) in enumerate(rows):
        j = (i + 1) % len(rows)
        new = edit(text, rows[j][1])
        half = len(text) // 2
        assert new == text[: len(text) - half] + rows[j][1][:half]
        other = s([new])[0]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(sketches[i]), as_text(other))
        assert (r.near_edited, r.near_next) == (likeness(sketches[i], other), likeness(sketches[i], sketches[j]))


def test_odd_rows(odd, none):
    rows = edited_likeness(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == "" and by[2].near_next == 1.0 and by[5].near_edited > 0
    assert by[3].edited_sha256 == hashlib.sha256(b"on").hexdigest() and by[3].near_edited == 0
    assert edited_likeness(none).collect() == [] and fingerprints(none).collect() == []
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints(odd).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in rows}
    one = edited_likeness(odd.filter("doc_id = 3")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ono").hexdigest()
