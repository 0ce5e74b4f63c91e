from collections import Counter, defaultdict

import numpy as np
from .tests_llm_words import words

from textctl.llm.graph import components
from textctl.llm.near_duplicates import Params, Sketcher, _shared, near_duplicates, shingles


def brute(rows):
    """(n_shingles, component) by id, from an inverted index of all shingles."""
    sets, root = {}, {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        both = Counter(o for g in s for o in index[g])
        for g in s:
            index[g].append(d)
        for o, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def check(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_equals_brute_force(docs, texts):
    check(docs, [(d, t) for d, t, _, _ in texts])


def test_group_of_variants_and_a_common_passage(spark):
    """Variants of one text, many pairs of which are under the threshold, and
    short texts that share a passage without being near duplicates."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(160):
        cut = rng.random(150) < rng.uniform(0, 0.06)
        rows.append((d, " ".join(f"x{rng.integers(9999)}" if c else w for w, c in zip(base, cut))))
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(d, passage + " " + " ".join(f"{d}u{i}" for i in range(30))) for d in range(200, 260)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_pairs_at_the_threshold_are_linked(spark):
    """1,500 pairs at 75 to 77 %, of small and large sets: none is lost, and
    as many pairs just under 75 % stay apart."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(3000):
        n = int(rng.integers(40, 400))
        shared = n - 4
        own = shared // 6  # 100 * shared >= 75 * (shared + 2 * own)
        own += k >= 1500

        def fresh(count, side, k=k):
            return [f"{k}{side}{i}" for i in range(count)]

        both = fresh(n, "m")
        rows += [(2 * k, " ".join(both + fresh(own, "x"))), (2 * k + 1, " ".join(both + fresh(own, "y")))]
    want = brute(rows)
    assert sum(not kept for _, _, kept in want.values()) == 1500
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == want


def test_sketch_agrees_as_often_as_sets_do():
    p = Params()
    s = Sketcher(p)
    for both, own in ((300, 50), (30, 5), (3000, 1000)):
        a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, both + 2 * own, dtype=np.uint64))
        x, y = s.sketch(a[: both + own]), s.sketch(np.concatenate([a[:both], a[both + own :]]))
        assert abs((x == y).mean() - both / (both + 2 * own)) < 0.07
        assert (x != (1 << 64) - 1).all()
    assert (s.sketch(np.array([5], np.uint64)) != (1 << 64) - 1).all()
    assert len(shingles("a b c", 5)) == 1 and len(shingles(" ", 5)) == 0


def test_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True) and by[2].component_id == 2 and by[6].component_id == 6
    assert by[3].component_id == by[4].component_id == 3 and by[7].kept and by[None].kept and by[None].component_id is None
    assert near_duplicates(none).collect() == []


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain[::-1] + hub + [(5, 5), (61, 60)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(62), 0), **dict.fromkeys([1000, *(b for _, b in hub)], 1000)}


def test_bands_are_dealt_once(spark):
    """The count of a bucket's members and the join with it read one exchange."""
    first = spark.createDataFrame([(i, [i, i // 2 + 1000, None if i == 5 else 5000]) for i in range(8)], "id long, bands array<long>")
    shared = _shared(first)
    got = sorted(tuple(r) for r in shared.collect())
    assert got == sorted([(i // 2 + 1000, i) for i in range(8)] + [(5000, i) for i in range(8) if i != 5])
    plan = shared._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("+- Exchange hashpartitioning") == 1
