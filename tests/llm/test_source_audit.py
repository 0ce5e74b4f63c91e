import re
from collections import Counter, defaultdict

from textctl.llm.source_audit import Params, audit

from .conftest import LOWER

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, p):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        spread = Counter(w for x in docs if x[0] == lang for w in set(x[2]))
        kept = {w for w, n in spread.items() if n >= p.min_docs}
        counts = defaultdict(Counter)
        for x in docs:
            if x[0] == lang:
                counts[x[1]].update(w for w in x[2] if w in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, shares = share(whole), {s: share(c) for s, c in counts.items()}
        for s, at in shares.items():
            pairs = [(-sum(f(at[w], other[w]) for w in kept), o.encode(), o) for o, other in shares.items() if o != s]
            terms = [(-f(at[w], q[w]), w.encode(), w) for w in kept if counts[s][w] and at[w] > q[w]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(terms)[: p.ranks])]
    return sorted(out)


def got(df, p):
    return sorted(tuple(r) for r in audit(df, p).select("lang", "source", "part", "item", "value", "rank").collect())


def test_documents(docs, texts):
    for p in (Params(), Params(min_docs=2, ranks=3, held=500)):  # tables emitted many times over
        want = brute(texts, p)
        assert got(docs, p) == want and {r[2] for r in want} == {"pair", "term"}


def test_ties_expand_in_utf8_order(spark):
    """More terms of one value than ranks; one source holds most rows."""
    tied = "zeta eta théta Ωmega alpha beta gamma delta epsilon iota kappa 日本語 lambda mu"
    rows = [(i, tied, "en", "big") for i in range(40)] + [(100 + i, "alpha common words", "en", f"s{i % 3}") for i in range(30)]
    rows += [(200 + i, "common", "en", "bare") for i in range(2)] + [(300, None, "en", "empty"), (301, "one two", "xx", "a"), (302, "three", "xx", "b")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).repartition(4)
    want = brute(rows, Params())
    assert got(df, Params()) == want
    assert [r[3] for r in want if r[:3] == ("xx", "a", "pair")] == ["b"] and {r[4] for r in want if r[0] == "xx"} == {0}
    assert sum(r[1:3] == ("big", "term") for r in want) == 10 and not [r for r in want if r[1:3] == ("empty", "term")]


def test_large_counts(spark):
    """Shares beyond what a long product holds."""
    from pyspark.sql import functions as F

    from textctl.llm.source_audit import _share

    c, n = 5 * 10**12 + 1, 10**13 + 7
    df = spark.createDataFrame([(c, n, 10**7)], "c long, n long, v long")
    assert df.select(_share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (c + 2) // (n + 2 * 10**7)


def test_odd_rows(odd, none):
    p = Params(min_docs=1)
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    assert got(odd, p) == brute(rows, p)
    assert audit(none).collect() == []
    only = odd.filter("text IS NULL OR text = ''")
    assert audit(only).collect() == []
