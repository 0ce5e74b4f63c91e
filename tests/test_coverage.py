"""Coverage counts against a brute-force statement of the rule (every
prompt of a task for every model with results there, minus the results)."""

from textctl.operators import validity as V


def brute(results, master):
    keys = {(t, m, p) for t, m, p in results}
    out = {}
    for t, m, p in keys:
        if (t, p) not in {(a, b) for a, b in master}:
            out[(t, m, "result_without_prompt")] = out.get((t, m, "result_without_prompt"), 0) + 1
    models = {(t, m) for t, m, _ in keys}
    for t, m in models:
        for a, b in master:  # every prompt row, duplicates and NULL keys included
            if a == t and (b is None or (t, m, b) not in keys):
                out[(t, m, "prompt_without_result")] = out.get((t, m, "prompt_without_result"), 0) + 1
    return out


def test_coverage_counts_match_pairs(spark):
    master = [("s", i) for i in range(10)] + [("s", 3), ("s", None), ("a", 1), ("a", 2), (None, 5)]
    results = (
        [("s", "m1", i) for i in range(10)]  # complete, but the duplicate and NULL prompt rows
        + [("s", "m2", i) for i in (0, 1, 2)]  # misses most
        + [("s", "m2", 99), ("a", "m1", 7)]  # orphans
        + [("a", "m1", 1), ("a", "m1", 1)]  # repeated result key
    )
    r = spark.createDataFrame(results, "task string, model string, prompt_id long")
    m = spark.createDataFrame(master, "task string, prompt_id long")
    got = {(x["task"], x["model"], x["kind"]): x["n"] for x in V.coverage(r, m).collect()}
    assert got == brute(results, master)
