from collections import defaultdict

from textctl.llm.line_spread import Params, without_boilerplate


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for i, line in enumerate((t or "").split("\n")):
            if k := line.strip(" \t\r"):
                if s is not None:
                    sites[k].add(s)
                first[k] = min(first.get(k, (d, i)), (d, i))
    out = {}
    for d, t, s in rows:
        lines = (t or "").split("\n")
        gone = [i for i, line in enumerate(lines) if len(sites[k := line.strip(" \t\r")]) >= least and k and first[k] != (d, i)]
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[d] = (None if t is None else kept if gone else t, sum(bool(x.strip(" \t\r")) for x in lines), len(gone))
    return out


def test_equals_brute_force_around_the_threshold(spark):
    rows = []
    for n in range(1, 31):  # the n-th line stands on n sites
        rows += [(n * 100 + i, f"own {n} {i}\n line {n}\t\n\nline {n}\nend", f"s{i}") for i in range(n)]
    rows.append((5000, None, "s1"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for least in (2, 10, 25):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in without_boilerplate(df, Params(min_sites=least)).collect()}
        assert got == brute(rows, least)


def test_documents(docs, texts):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in without_boilerplate(docs, Params(min_sites=5)).collect()}
    want = brute([(d, t, s) for d, t, _, s in texts], 5)
    assert got == want and any(x[2] for x in want.values())


def test_odd_rows(odd, none):
    rows = without_boilerplate(odd, Params(min_sites=1)).collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(rows[0].asDict())
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[6].n_lines == 0 and by[5].n_removed == 0
    assert without_boilerplate(none).collect() == []
