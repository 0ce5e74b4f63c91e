"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, context_mixing, decontaminate, language, licences, line_spread, mixing, near_duplicates, order_minhash, sentence_spans, sharded_lloyd, source_audit, token_counts
from .common import remainder, table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_sentences", "n_removed", F.size("removed").cast("long").alias("n_ranges"), "removed", F.sha2("clean", 256).alias("clean_sha256"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return context_mixing.score(docs, remainder(F.col("doc_id"), 10) == 0)


#: Any rank file of the tokenizers folder.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), RANKS)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs).select("doc_id", "n_tokens", "probability", "kept")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree of files: source / thousands / hundreds / id."""
    n = F.col("doc_id")
    path = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 100"), F.concat(n.cast("string"), F.lit(".txt")))
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.learn(docs, ~held_out)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "known")


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    clean = line_spread.without_boilerplate(docs)
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("clean_sha256"))


def op11_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd.report(*sharded_lloyd.cluster(table(spark, sf_dir, "embeddings")))


#: A conversation whose texts hold the template's own strings.
FORGED = "SELECT -1 AS conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.formatted(turns.unionByName(spark.sql(FORGED).to(turns.schema))))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""

OP10_SQL = r"""
WITH l AS (SELECT doc_id, source, pos, line, trim(line, E' \t\r') AS k FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
b AS (SELECT k, min((doc_id, pos)) AS f FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.*, b.k IS NOT NULL AND (doc_id, pos) <> f AS gone FROM l LEFT JOIN b ON l.k = b.k)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n_removed > 0 THEN coalesce(clean, '') ELSE d.text END) AS clean_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS clean
  FROM m GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""


def _licence_sql(p: licences.Params) -> str:
    quoted = lambda t: t.replace("'", "''")
    rows = ", ".join(f"('{quoted(name)}', {i}, '{quoted(t)}')" for name, texts in p.templates.items() for i, t in enumerate(texts))
    split = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""
WITH t AS (SELECT licence, variant, unnest({split.format("line")}) AS word FROM (VALUES {rows}) v(licence, variant, line)),
tt AS (SELECT licence, variant, word, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, text, concat_ws('/', source, doc_id // 1000, doc_id // 100) AS dir, concat_ws('/', source, doc_id // 1000, doc_id // 100, doc_id || '.txt') AS path FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
u AS MATERIALIZED (SELECT doc_id, pos, {split.format("line")} AS words FROM l WHERE len({split.format("line")}) > 0),
n AS (SELECT count(*) AS n FROM u),
w AS MATERIALIZED (SELECT doc_id, pos, len(words) AS n_words, unnest(words) AS word FROM u),
tf AS (SELECT doc_id, pos, n_words, word, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT k.word, ln(((SELECT n FROM n) + 1.0) / (count(tf.word) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM tt) k LEFT JOIN tf ON tf.word = k.word GROUP BY k.word),
tw AS (SELECT licence, variant, tt.word, tf * idf AS x, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY licence, variant)) AS norm FROM tt JOIN df ON tt.word = df.word),
uw AS (SELECT doc_id, pos, n_words, tf.word, tf * coalesce(idf, ln((SELECT n FROM n) + 1.0) + 1) AS x FROM tf LEFT JOIN df ON tf.word = df.word),
un AS (SELECT doc_id, pos, sqrt(sum(x * x)) AS norm FROM uw GROUP BY ALL),
dot AS (SELECT doc_id, pos, n_words, licence, variant, sum(uw.x * tw.x / tw.norm) AS dot FROM uw JOIN tw ON uw.word = tw.word GROUP BY ALL),
s AS (SELECT dot.doc_id, dot.pos, n_words, licence, round(dot / un.norm, 6) AS cosine FROM dot JOIN un ON dot.doc_id = un.doc_id AND dot.pos = un.pos WHERE round(dot / un.norm, 6) >= {p.threshold}),
m AS (SELECT doc_id, pos, n_words, licence, cosine FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY cosine DESC, licence) = 1),
o AS (SELECT doc_id, licence, cosine, sum(n_words) OVER (PARTITION BY doc_id) AS inside FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, pos, licence) = 1),
f AS (SELECT d.dir, o.* FROM o JOIN d ON o.doc_id = d.doc_id WHERE inside >= {p.file_share} * len({split.format("text")})),
g AS (SELECT dir, licence, cosine FROM f QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, doc_id) = 1),
a AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS up FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM d))),
h AS (SELECT a.dir, a.up, licence, cosine FROM a JOIN g ON a.up = g.dir QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY k DESC) = 1)
SELECT d.doc_id, d.path, coalesce(o.licence, h.licence) AS licence,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN h.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN o.licence IS NULL THEN h.cosine ELSE o.cosine END AS cosine,
  CASE WHEN o.licence IS NULL THEN h.up END AS from_dir
FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN h ON d.dir = h.dir
"""


def _rake_sql(p: mixing.Params) -> str:
    """The raking as a recursion over rounds; cells and categories are joined
    in plain SQL. The kept share follows the rounds as in the operator."""
    steps = "r"
    for _ in range(mixing.STRIDE):
        for d in mixing.DIMENSIONS:
            steps = f"(SELECT * REPLACE (least(share * target_{d} / sum(share) OVER (PARTITION BY i, {d}), seen / keep) AS share) FROM {steps})"
    gaps = ", ".join(f"abs(sum(share) OVER (PARTITION BY {d}) - target_{d}) AS gap_{d}" for d in mixing.DIMENSIONS)
    wanted = [
        f"w_{d} AS (SELECT {d}, sum(seen) AS seen, power(sum(seen), {p.targets[d]}) AS want FROM c GROUP BY {d}), "
        f"t_{d} AS (SELECT {d}, want / (SELECT sum(want) FROM w_{d}) AS target_{d}, seen / (want / (SELECT sum(want) FROM w_{d})) AS most FROM w_{d})"
        for d in mixing.DIMENSIONS
    ]
    joins = " ".join(f"JOIN (SELECT {d}, target_{d} FROM t_{d}) USING ({d})" for d in mixing.DIMENSIONS)
    most = ", ".join(f"(SELECT min(most) FROM t_{d})" for d in mixing.DIMENSIONS)
    floor = min(p.least, p.budget)
    columns = "source, lang, topic, seen, target_source, target_lang, target_topic"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN contains(text, 'icens') THEN 'legal' WHEN contains(text, ' | ') THEN 'tabular'
    WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) / (SELECT sum(n_tokens) FROM d) AS seen FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{", ".join(wanted)},
r AS (SELECT 0 AS i, CAST('infinity' AS DOUBLE) AS gap, false AS stop, greatest(least({p.budget}, {p.margin} * least({most})), {floor}) AS keep, {columns}, seen AS share FROM c {joins}
  UNION ALL
  SELECT i, gap, gap <= {p.tolerance} OR (stalled AND keep <= {floor}), CASE WHEN stalled AND gap > {p.tolerance} THEN greatest(keep * 0.9, {floor}) ELSE keep END, {columns}, share FROM (
    SELECT *, gap > {p.stall} * before AS stalled FROM (
      SELECT i + {mixing.STRIDE} AS i, gap AS before, max(greatest(gap_source, gap_lang, gap_topic)) OVER () AS gap, keep, {columns}, share
      FROM (SELECT *, {gaps} FROM {steps})
      WHERE NOT stop AND i < {p.rounds}))),
p AS (SELECT doc_id, n_tokens, coalesce(round(least(1.0, used * share / seen), 6), 0) AS probability FROM d LEFT JOIN (
  SELECT * FROM (SELECT *, min(keep) OVER () AS used FROM r) WHERE i = (SELECT max(i) FROM r)) USING (source, lang, topic))
SELECT doc_id, n_tokens, probability,
  CAST('0x' || substr(md5('{p.seed}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS kept FROM p
"""


def _lloyd_sql(p: sharded_lloyd.Params) -> str:
    """The rounds unrolled; rows are numbered, as ids may repeat."""
    near = "SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.i, t.c, CAST(list_sum([(x.x[j] - t.x[j]) * (x.x[j] - t.x[j]) FOR j IN range(1, {dims} + 1)]) AS BIGINT) AS d FROM x, c{r} t) GROUP BY i"
    steps = []
    for r in range(p.rounds + 1):
        steps.append(f"n{r} AS MATERIALIZED ({near.format(dims=p.dims, r=r)})")
        if r < p.rounds:
            mean = "list(CASE WHEN s % n < 0 THEN (s - (s % n + n)) // n ELSE (s - s % n) // n END ORDER BY j)"
            sums = f"SELECT n{r}.c, j, CAST(sum(x.x[j]) AS BIGINT) AS s, count(*) AS n FROM n{r} JOIN x USING (i), range(1, {p.dims} + 1) q(j) GROUP BY n{r}.c, j"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT c, {mean} AS x FROM ({sums}) GROUP BY c) m ON o.c = m.c)")
    last = p.rounds
    return f"""
WITH k AS (SELECT vec_id, [CAST(floor({p.scale} * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {p.dims} AND len([y FOR y IN embedding IF isfinite(y)]) = {p.dims}),
x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}:' || CAST(vec_id AS VARCHAR)), x) AS i, * FROM k),
c0 AS MATERIALIZED (SELECT CAST(i - 1 AS INTEGER) AS c, x FROM x WHERE i <= {p.k}),
{", ".join(steps)}
SELECT vec_id, n{last}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n{last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(t.x, ',')) AS centroid_sha256
FROM n{last} JOIN x USING (i) JOIN c{last} t ON t.c = n{last}.c
"""


def _chat_sql() -> str:
    start, sep, end = (len(s) for s in (chat_format.START, chat_format.SEP, chat_format.END))
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens,
  replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C') AS name, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS inside FROM t),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, count(*) FILTER (opens) AS n_blocks,
  sum(length(inside) + CASE WHEN opens THEN {start + end + 2} + length(name) ELSE {sep} END) AS chars FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, n_blocks FROM a
"""


def _audit_sql(p: source_audit.Params) -> str:
    """Every group gives every kept term its share, zero counts included."""
    share = "CAST(1 + (CAST(1000000000 AS HUGEINT) * ({} + 2)) // ({} + 2 * v) AS BIGINT)"
    f = "(p - q) * (p - q) // (p + q)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {p.min_docs}),
l AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM g LEFT JOIN o ON g.lang = o.lang AND g.source = o.source GROUP BY ALL),
s AS MATERIALIZED (SELECT m.lang, m.source, k.term, coalesce(o.c, 0) AS c, {share.format("coalesce(o.c, 0)", "m.n")} AS p, {share.format("k.c", "l.n")} AS q
  FROM m JOIN k ON m.lang = k.lang JOIN l ON m.lang = l.lang LEFT JOIN o ON o.lang = m.lang AND o.source = m.source AND o.term = k.term),
t AS (SELECT lang, source, term AS item, {f} AS value FROM s WHERE c > 0 AND p > q),
h AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN h ON h.lang = a.lang AND h.source = a.source AND h.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM t QUALIFY rank <= {p.ranks}
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` at the top of the repository."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_decontamination": op2_decontamination,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_context_mixing": op4_context_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_licences": op7_licences,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_language": op9_language,
    "op10_line_spread": op10_line_spread,
    "op11_sharded_lloyd": op11_sharded_lloyd,
    "op12_chat_format": op12_chat_format,
    "op13_source_audit": op13_source_audit,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op6_mixing": _rake_sql(mixing.Params()),
    "op7_licences": _licence_sql(licences.Params()),
    "op10_line_spread": OP10_SQL,
    "op11_sharded_lloyd": _lloyd_sql(sharded_lloyd.Params()),
    "op12_chat_format": _chat_sql(),
    "op13_source_audit": _audit_sql(source_audit.Params()),
}
