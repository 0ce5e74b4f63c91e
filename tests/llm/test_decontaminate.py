import hashlib

from .tests_llm_words import item_words

from textctl.llm.decontaminate import contamination, summary


def brute(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = item_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_equals_brute_force_in_one_block_and_in_many(spark, texts):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    # a passage with other case and marks, an item of three words, equal items
    quoted = " -- ".join(items[0][1].upper().split()[:14])
    more = [(10_001, "x " + quoted + " y"), (10_002, "It ends: Short ITEM Words"), (10_003, None), (10_004, ""), (None, quoted)]
    items += [(900, "short item words"), (901, "short item words"), (902, None), (903, "?!")]
    rows = [(d, t) for d, t, _, _ in texts] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert sum(r[-1] for r in want) >= 3
    for size in (2 << 20, 2000):
        got = contamination(docs, bench, block_bytes=size)
        assert sorted(map(tuple, summary(got).collect()), key=repr) == want
        spans = {r.row.doc_id: r.spans for r in got.collect()}
        (s,) = spans[10_002]
        assert "It ends: Short ITEM Words"[s.start : s.end] == "Short ITEM Words"
        (s,) = spans[10_001]
        assert item_words(more[0][1][s.start : s.end]) == item_words(quoted)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "no id here"), (None, "one"), (2, None)], "item_id long, text string")
    got = {(r.row.doc_id, r.row.text): r for r in contamination(odd, bench).collect()}
    assert len(contamination(odd, bench).collect()) == odd.count()
    assert got[(None, "no id here")].items == [1] and got[(3, "one")].items == [] and len(got[(3, "one")].spans) == 1
    assert got[(1, None)].n_words == 0 and got[(1, None)].spans == []
    assert contamination(none, bench).collect() == []
    empty = bench.limit(0)
    assert all(r.spans == [] for r in contamination(odd, empty).collect())
