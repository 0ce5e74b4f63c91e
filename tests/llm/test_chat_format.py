import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from textctl.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "<|im_end|>", "<\\|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<<|", "<", "|", "<\\\\|\\", "a<|im_sep|>b", "\n", "é<|𝄞|>", "end<", "$1 \\1", "%7C%25", "<|im_end|>\n<|im_start|>"]


def want(rows):
    """Brute force: turns, merged blocks, formatted text and loss per conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        esc = lambda s: re.sub(r"<(\\*)\|", r"<\1\\|", s)
        name = lambda r: r.replace("%", "%25").replace("\n", "%0A").replace("|", "%7C")
        text, spans = "", []
        for role, run in itertools.groupby(turns, key=lambda t: t[1]):
            text += C.START + name(role) + "\n"
            for i, (_, _, x) in enumerate(run):
                text += C.SEP if i else ""
                if role == "assistant":
                    spans.append((len(text), len(esc(x))))
                text += esc(x)
            text += C.END + "\n"
        out[conv] = ([(r, x) for _, r, x in turns], text, spans)
    return out


def check(spark, rows):
    df = C.formatted(spark.createDataFrame(rows, SCHEMA).repartition(3))
    expected = want(rows)
    got = df.withColumn("turns", C.read_back(F.col("formatted"))).withColumn("texts", C.loss_texts(F.col("formatted"), F.col("loss"))).collect()
    assert {r.conv_id for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        turns, text, spans = expected[r.conv_id]
        assert r.formatted == text and [tuple(s) for s in r.loss] == spans
        assert [tuple(t) for t in r.turns] == turns
        assert r.texts == [x for role, x in turns if role == "assistant"]
        assert r.n_blocks == len(list(itertools.groupby(role for role, _ in turns)))
    for r in C.digests(df).collect():
        turns, text, _ = expected[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(text))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_every_text_returns(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(NASTY)] + [(i, 1, "assistant", NASTY[-1 - i]) for i in range(len(NASTY))]
    rows += [(99, i, ("user", "assistant")[i // 3 % 2], t) for i, t in enumerate(NASTY)]  # runs of one role
    rows += [(100, i, r, "x") for i, r in enumerate(["a|b", "a\nb", "%0A", "%", "<|im_end|>", "Assistant"])]
    check(spark, rows)


def test_round_trip_of_random_texts(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("<|\\ai\n%é") for _ in range(rnd.randrange(13)))
    check(spark, [(rnd.randrange(60), rnd.randrange(8), rnd.choice(["user", "assistant", "a\n", "|", word()]), word()) for _ in range(900)])


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "no role"), (1, None, "user", "no turn"), (None, 0, "user", "no id"), (None, 0, "assistant", ""), (2, 5, "assistant", "tie b"), (2, 5, "assistant", "tie a"), (2, 5, "assistant", "tie a")]
    rows += [(3, 0, "user", "word " * 200_000), (3, 1, "assistant", "<|" * 100_000)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(1000)]
    check(spark, rows)
    none = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.formatted(none)).collect() == []
    clash = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], SCHEMA + ", formatted string, loss string")
    assert C.formatted(clash).columns == ["conv_id", "n_blocks", "formatted", "loss"] and C.formatted(clash).first().formatted == f"{C.START}user\na{C.END}\n"


def test_only_expressions(spark):
    plan = C.digests(C.formatted(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
