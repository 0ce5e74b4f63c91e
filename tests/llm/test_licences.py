from pyspark.sql import functions as F

from textctl.llm.licences import BODIES, Params, _needed, block_matches, frequencies, scan

TREE = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/x.txt", "prose without any"),
    (3, "a/b/y.txt", "more prose"),
    (4, "a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
    (5, "a/b/c/z.txt", "words\nwords words"),
    (6, "a/b/c/own.txt", "prose and so on\nlicensed under the APACHE license -- version 2.0\n" + "many words " * 40),
    (7, "q/r/none.txt", "the licence of the public work is not here, under the version of the day"),
    (8, "top.txt", "All rights reserved."),
    (9, "other.txt", "nothing"),
    (10, "a/b/c/tie", "This work is licensed under the GNU General Public License, version 2."),
]


def test_tree(spark):
    df = spark.createDataFrame(TREE, "doc_id long, path string, text string").repartition(3)
    got = {r.doc_id: (r.licence, r.how, r.from_dir) for r in scan(df).collect()}
    assert got == {
        1: ("MIT", "own", None),
        2: ("MIT", "inherited", "a"),
        3: ("MIT", "inherited", "a"),
        4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "inherited", "a/b/c"),
        6: ("Apache-2.0", "own", None),
        7: (None, "none", None),
        8: ("Proprietary", "own", None),
        9: (None, "none", None),
        10: ("GPL-2.0", "own", None),
    }


def test_needed_words_are_a_bound():
    """No choice of the other words reaches the threshold."""
    vectors = {("x", 0): {"a": 0.8, "b": 0.5, "c": 0.3, "d": 0.1414}}
    for t in (0.3, 0.5, 0.7, 0.9):
        rest = [w for w in vectors["x", 0] if w not in _needed(vectors, t)]
        assert sum(vectors["x", 0][w] ** 2 for w in rest) ** 0.5 < t


def test_odd_rows(odd, none):
    rows = scan(odd.withColumn("path", F.when(F.col("doc_id") > 3, "d/f"))).collect()
    assert len(rows) == odd.count() and all(r.how == "none" for r in rows)
    assert scan(none.withColumn("path", F.lit("a/b"))).collect() == []
    twice = none.sparkSession.createDataFrame([(1, "All rights reserved.", "d/L")] * 2 + [(2, None, "d/f")], "doc_id long, text string, path string")
    assert sorted((r.doc_id, r.licence) for r in scan(twice).collect()) == [(1, "Proprietary"), (1, "Proprietary"), (2, "Proprietary")]
    assert scan(odd.withColumn("path", F.lit("p")), Params(templates={})).filter("licence IS NOT NULL").collect() == []


MIT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2019, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_licence_bodies_and_wrapped_headers(spark):
    wrapped = "// This work is licensed under the GNU\n// General Public License, version 3.\nint main() { return zero; }\n" + "code line here\n" * 30
    rows = [(1, "m/LICENSE", MIT), (2, "m/x.py", "code alone"), (3, "b/LICENSE", BSD), (4, "b/c/y.py", "more code"), (5, "w/z.c", wrapped), (6, "w/prose", "no warranty of any kind in this prose, all of it")]
    got = {r.doc_id: (r.licence, r.how) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("BSD-2-Clause", "own"), 4: ("BSD-2-Clause", "inherited"), 5: ("GPL-3.0", "own"), 6: (None, "none")}


def test_terms_of_blocks_stay_with_their_file(spark):
    """One exchange, of files; the sums over a block's terms need none."""
    text = BODIES["MIT"][0]
    files = spark.createDataFrame([(1, 11, text + "\n\n" + "prose and so on\n" * 30), (2, 12, "prose\n" * 30), (3, 13, text), (None, 14, text)], "id long, mark long, text string")
    found = block_matches(files, known=frequencies(files))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.mark, r.licence, r.body) for r in found.collect()) == [(11, "MIT", True), (13, "MIT", True), (14, "MIT", True)]


def test_texts_are_not_sent_to_be_counted(spark, tmp_path):
    """All a scan shuffles is small beside texts without a licence."""
    import random

    draw = random.Random(7)
    rows = [(i, f"d{i}/f", "".join(draw.choices("abcdefgh ", k=200_000)) + ("\nAll rights reserved." if i == 3 else "")) for i in range(20)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)
    files.write.parquet(str(tmp_path / "files"))
    found = scan(spark.read.parquet(str(tmp_path / "files")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan
    assert {r.doc_id: r.licence for r in found.collect()} == {i: "Proprietary" if i == 3 else None for i in range(20)}
