import pytest

from pyspark.sql import functions as F

from textctl.llm.mixing import DIMENSIONS, Params, cells_of, marginals, mixed, rake


def test_marginals_meet_targets(spark):
    cells = [(f"s{i}", f"l{j}", f"t{k}", 10 + 37 * i + 11 * j * k) for i in range(4) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    p = Params(targets={"source": 0.5, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": 1.0}, rounds=40, budget=0.05, tolerance=1e-9)
    got = rake(df, p)
    assert {r.lang: round(r.s, 6) for r in got.groupBy("lang").agg(F.sum("share").alias("s")).collect()} == {"l0": 0.5, "l1": 0.3, "l2": 0.2}
    total = sum(c[3] for c in cells)
    root = {s: (sum(c[3] for c in cells if c[0] == s) / total) ** 0.5 for s in {c[0] for c in cells}}
    for r in got.groupBy("source").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(root[r.source] / sum(root.values()), abs=1e-6)
    # where no cell is bounded, factors are a product of one number per category: raking keeps the odds of the cells
    by = {tuple(r[d] for d in DIMENSIONS): r.factor for r in got.collect()}
    assert by["s0", "l0", "t0"] * by["s1", "l1", "t0"] == pytest.approx(by["s0", "l1", "t0"] * by["s1", "l0", "t0"])


def test_sample_is_deterministic_and_near_its_expectation(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("five words are in here").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    one, two = (sorted(mixed(x).select("doc_id", "probability", "kept").collect()) for x in (df.repartition(3), df.repartition(11)))
    assert one == two and {r.doc_id for r in one} == set(range(4000))
    assert sum(r.kept for r in one) == pytest.approx(sum(r.probability for r in one), abs=120)


def test_odd_rows(odd, none):
    rows = mixed(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) - {"kept"} <= set(rows[0].asDict())
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[6].n_tokens == 0 and by[5].n_tokens == 120_000
    assert all(0 <= r.probability <= 1 for r in rows)
    assert mixed(none).collect() == []
    assert mixed(odd.filter("doc_id < 3")).filter("kept").collect() == []


def brute(cells, shares, p):
    """Raking with the bound inside, on plain dictionaries."""
    total = sum(cells.values())
    seen = {c: t / total for c, t in cells.items()}
    target = [{}, {}, {}]
    for n, d in enumerate(DIMENSIONS):
        of = {}
        for c, x in seen.items():
            of[c[n]] = of.get(c[n], 0) + x
        want = {k: (x ** shares[d] if not isinstance(shares[d], dict) else shares[d].get(k, x)) if x else 0 for k, x in of.items()}
        target[n] = {k: w / sum(want.values()) for k, w in want.items()}
        of_target = [of[k] / t for k, t in target[n].items() if t]
        most = min([most, *of_target]) if n else min(of_target)
    keep = max(min(p.budget, p.margin * most), min(p.least, p.budget))
    share, turn, gap, stop = dict(seen), 0, float("inf"), False
    sums = lambda n: {k: sum(x for c, x in share.items() if c[n] == k) for k in target[n]}
    while not stop and turn < p.rounds:
        for _ in range(2):
            for n in range(3):
                now = sums(n)
                share = {c: min(x * target[n][c[n]] / now[c[n]] if now[c[n]] else 0, seen[c] / keep) for c, x in share.items()}
        turn += 2
        before, gap = gap, max(abs(x - target[n][k]) for n in range(3) for k, x in sums(n).items())
        stalled = gap > p.stall * before
        stop = gap <= p.tolerance or (stalled and keep <= min(p.least, p.budget))
        if stalled and not stop:
            keep = max(keep * 0.9, min(p.least, p.budget))
    return {c: min(1, keep * share[c] / x) if x else 0 for c, x in seen.items()}, gap


def skewed():
    cells = {(f"s{i}", f"l{j}", f"t{k}"): 5 + 3000 // (1 + 7 * i + 3 * j + 11 * k * i) for i in range(6) for j in range(3) for k in range(3)}
    cells["s0", "l0", "t0"] = 90_000  # a hot source
    return cells


@pytest.mark.parametrize("p", [Params(least=0.0), Params(targets={"source": 0.3, "lang": {"l0": 0.4, "l2": 0.3}, "topic": 0.5}, least=0.01)])
def test_skewed_marginals_meet_targets(spark, p):
    cells = skewed()
    raked = rake(spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long"), p)
    rows = marginals(raked).collect()
    assert len(rows) == 12 and all(abs(r.target - r.reached) < 1e-3 for r in rows), rows
    want, gap = brute(cells, {d: p.targets.get(d, 1.0) for d in DIMENSIONS}, p)
    assert gap <= p.tolerance
    for r in raked.collect():
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], abs=1e-9) and r.probability <= 1


def test_a_tiny_source_does_not_cost_the_corpus(spark):
    """2,000 documents of one source and 2 of another: what cannot be reached
    is reported, the rest is kept at the least share."""
    df = spark.range(2002).selectExpr("id AS doc_id", "'five words are in here' AS text", "'en' AS lang", "if(id < 2000, 'big', 'tiny') AS source")
    got = {(r.dim, r.category): r for r in marginals(rake(cells_of(df), Params(least=0.1))).collect()}
    tiny = got["source", "tiny"]
    assert tiny.target > 0.03 and tiny.reached < tiny.target and tiny.kept_tokens == pytest.approx(10)  # all it has
    assert sum(r.kept_tokens for (d, _), r in got.items() if d == "source") == pytest.approx(0.1 * 10_010, rel=0.02)
    low = Params(least=0.0)
    got = {(r.dim, r.category): r for r in marginals(rake(cells_of(df), low)).collect()}
    assert all(abs(r.target - r.reached) < 1e-3 for r in got.values())


def test_plan_is_native_and_small(spark, docs):
    plan = mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 2, plan
