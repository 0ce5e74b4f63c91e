import random
import re

from textctl.llm.sentence_spans import Params, _words, without_repeats

UNSPACED = re.compile("[　-鿿＀-ｿ฀-໿က-Ⴟក-៿\U00020000-\U0003ffff]")


def tokens(t):
    """Start, weight and lower-cased word."""
    out = []
    for m in re.finditer(r"[^ \t\n\x0b-\r]+", t):
        for x in re.finditer(UNSPACED.pattern + "|(?:(?!" + UNSPACED.pattern + ").)+", m[0]):
            w = x[0]
            out.append((m.start() + x.start(), 1 if UNSPACED.match(w) else 2, re.sub("[A-Z]+", lambda y: y[0].lower(), w)))
    return out


def sentences(t, p=Params()):
    cuts = {0, len(t)} | {m.end() for m in re.finditer(r"(?<=[.!?;:,])[ \t\x0b-\r]+|\n+|[、。！，：；？]", t)}
    toks = tokens(t)
    order = [int(h) for h in _words("".join(re.sub("[A-Z]+", lambda y: y[0].lower(), t)).encode())[2]]
    assert len(order) == len(toks)
    small = set()
    for k in range(len(toks) - p.window + 1):
        small.add(max(range(k, k + p.window), key=lambda i: (-order[i], i)))
    edges = sorted(cuts)
    for a, b in zip(edges, edges[1:]):
        inside = [i for i, (at, _, _) in enumerate(toks) if a <= at < b]
        if sum(toks[i][1] for i in inside) > 2 * p.words:
            cuts |= {toks[i][0] for i in inside if i in small}
    edges = sorted(cuts)
    return [(a, b, [x for x in toks if a <= x[0] < b]) for a, b in zip(edges, edges[1:])]


def brute(rows, p=Params()):
    """Cleaned text, sentences and removed sentences by id, from every run of
    sentences that is long enough, not the shortest ones alone."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        cut = sentences(t, p)
        filled, gone = [i for i, c in enumerate(cut) if c[2]], set()
        for k in range(len(filled)):
            run, weight = [], 0
            for e in range(k, len(filled)):
                run += [x[2] for x in cut[filled[e]][2]]
                weight += sum(x[1] for x in cut[filled[e]][2])
                if weight >= 4 * p.words or (weight >= 2 * p.words and e - k + 1 >= p.sentences):
                    if tuple(run) in seen:
                        gone.update(range(filled[k], filled[e] + 1))
                    seen.add(tuple(run))
        out[d] = ("".join(t[a:b] for i, (a, b, _) in enumerate(cut) if i not in gone), len(cut), len(gone))
    return out


def check(spark, rows):
    got = {r.row.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {d: (r.clean, r.n_sentences, r.n_removed) for d, r in got.items()} == brute(rows)
    return got


def test_equals_brute_force(spark, texts):
    passage = "A first part of it, the second one. Then a third; and more words come: in the end it has over twenty words, all the same."
    rows = [(d, t) for d, t, _, _ in texts][:60]
    rows += [(9001, f"Only here. {passage} Rest of one."), (9002, f"Unlike é text 日本。 {passage.upper()}\nOther rest."), (9003, "clean words only, here")]
    rows += [(9004, "one long row without marks " * 8), (9005, "one long row without marks " * 8)]
    got = check(spark, rows)
    # the passage stays where it stands first; where it repeats, what is its own stays
    assert got[9001].n_removed == got[9003].n_removed == 0
    (r,) = got[9002].removed
    text = dict(rows)[9002]
    assert text[r.start : r.end].strip() in passage.upper() and got[9002].clean == text[: r.start] + text[r.end :]


def test_unspaced_scripts(spark):
    passage = "東京の天気は今日も晴れています。明日は雨が降るでしょう、傘を持って行ってください。週末は山へ登る予定です！友人と一緒に行きます。とても楽しみです。"
    rows = [(1, "これは最初の文書です。" + passage * 3), (2, "別の文書がここにあります。" + passage * 3 + "おわり。"), (3, "ไทยมีหลายภาษา𠮷 mixed 漢字abc です")]
    got = check(spark, rows)
    assert got[2].clean == "別の文書がここにあります。おわり。" and got[3].n_removed == 0
    assert got[1].clean == "これは最初の文書です。" + passage


def test_passages_without_marks(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(0, 60, 2):
        passage = [word() for _ in range(64)]
        for j in (i, i + 1):
            rows.append((j, " ".join([word() for _ in range(rnd.randint(1, 30))] + passage + [word() for _ in range(rnd.randint(1, 30))])))
    got = check(spark, rows)
    for i in range(0, 60, 2):
        assert got[i].n_removed == 0
        gone = sum(len(dict(rows)[i + 1][r.start : r.end].split()) for r in got[i + 1].removed)
        assert 64 - 2 * Params().window <= gone <= 64


def test_hot_passages_ties_and_text_ids(spark):
    """Passages in a third of all rows, within batches and across them; ids
    are text, rows repeat, one id has two texts, one is null."""
    rnd = random.Random(7)
    own = lambda n: " ".join("".join(rnd.choice("klmnopq") for _ in range(5)) for _ in range(n))
    hot = [own(30) + ". " + own(25) + ".", own(70)]
    rows = [(f"d{i}", f"{own(12)}. {rnd.choice(hot)} {own(9)}" if i % 3 == 0 else own(40)) for i in range(300)]
    rows += [("copy", rows[0][1]), ("d0", rows[0][1])]
    want = brute(rows[:-1])
    got = without_repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.clean, r.n_sentences, r.n_removed) == want[r.row.doc_id]
    first, second = f"{own(20)}. {own(20)}.", f"{own(30)}. {own(20)}."
    twice = [(None, first), ("a", second), ("a", first + " tail of it"), ("b", first), ("b", second)]
    got = {(r.row.doc_id, r.row.text): r.n_removed for r in without_repeats(spark.createDataFrame(twice, "doc_id string, text string").coalesce(1)).collect()}
    assert got[(None, first)] == got[("a", second)] == 0
    assert got[("a", twice[2][1])] > 0 and got[("b", first)] > 0 and got[("b", second)] > 0


def test_odd_rows(odd, none):
    rows = without_repeats(odd).collect()
    assert len(rows) == odd.count() and rows[0].row.asDict().keys() == set(odd.columns)
    by = {r.row.doc_id: r for r in rows}
    assert by[1].clean is None and by[2].clean == "" and by[2].n_sentences == 0 and by[5].n_removed == 0 and by[7].clean == "repeated row"
    assert without_repeats(none).collect() == []
