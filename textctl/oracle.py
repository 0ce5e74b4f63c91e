"""DuckDB SQL for the differential check: the same fixture rules and the
same operator semantics, written independently as SQL over the shared
parquet views (``documents``, ``labels``, ...)."""

from __future__ import annotations

from .schemas import ASPECTS, SENTINEL, TASKS
from .sources.fixtures import FOOTER, FORMAT_TEXT, HEADER, KEYWORD_BY_LANG, PROHIBITED_BY_LANG, generated_models
from .sources.registry import suffix_py

BL = "(' ' || chr(12288) || chr(10) || chr(9))"


def q(s: str) -> str:
    """SQL string literal; newlines become ``chr(10)``."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


def _case(col: str, table: dict[str, str]) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def nb(x: str) -> str:
    return f"translate({x}, {BL}, '')"


TASK_OF = "CASE prompt_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'ad_text' ELSE 'pros_and_cons' END"


def prompts_cte(with_text: bool = True) -> str:
    return f"""prompts AS (
  SELECT {TASK_OF} AS task, prompt_id, title, base_text, min_chars, min_chars + 1500 AS max_chars,
         keyword_answer, prohibited_word_answer,
         {q(FORMAT_TEXT)} AS format,
         CAST(min_chars AS VARCHAR) || '文字以上' || CAST(min_chars + 1500 AS VARCHAR) || '文字以下で出力してください。' AS char_count,
         '「' || keyword_answer || '」という語を必ず使ってください。' AS keyword,
         '「' || prohibited_word_answer || '」という語を使わないでください。' AS prohibited_word
  FROM (SELECT doc_id AS prompt_id, source AS title, text AS base_text,
               CAST(250 * (doc_id % 5) AS INTEGER) AS min_chars,
               {_case('lang', KEYWORD_BY_LANG)} AS keyword_answer,
               {_case('lang', PROHIBITED_BY_LANG)} AS prohibited_word_answer
        FROM documents) d)"""


def combos_literal(iters: int = 3) -> str:
    items = []
    for mi, mp in generated_models():
        for a in ASPECTS:
            for i in range(iters):
                items.append(
                    f"{{'model_idx': {mi}, 'model_path': {q(mp)}, 'model': {q(suffix_py(mp))}, 'aspect': {q(a)}, 'iter': {i}}}"
                )
    return "[" + ", ".join(items) + "]"


def results_cte() -> str:
    return f"""gen AS (
  SELECT prompt_id, text, unnest({combos_literal()}) AS c
  FROM (SELECT doc_id AS prompt_id, text FROM documents) d),
gen2 AS (
  SELECT {TASK_OF} AS task, CAST(c.model_idx AS INTEGER) AS model_idx, c.model_path AS model_path, c.model AS model,
         prompt_id, c.aspect AS aspect, CAST(c.iter AS INTEGER) AS iter,
         text AS body,
         (prompt_id + c.iter + c.model_idx) % 7 AS h
  FROM gen),
results AS (
  SELECT task, model_idx, model_path, model, prompt_id, aspect, iter,
         CASE h WHEN 0 THEN {q(HEADER)} || body WHEN 1 THEN body || {q(FOOTER)} ELSE body END AS raw_text,
         CASE WHEN h = 6 THEN {q(SENTINEL)} ELSE body END AS clean_text
  FROM gen2)"""


FORMAT_SQL = f"""CASE WHEN clean_text = {q(SENTINEL)} THEN false
       WHEN length({nb('clean_text')}) > 10
       THEN left({nb('raw_text')}, 10) = left({nb('clean_text')}, 10) AND right({nb('raw_text')}, 10) = right({nb('clean_text')}, 10) END"""


def valid_cte() -> str:
    s = q(SENTINEL)
    return f"""valid AS (
  SELECT r.task, r.model_path, r.model, r.prompt_id, r.aspect, r.iter, r.raw_text, r.clean_text,
    CASE r.aspect
      WHEN 'format' THEN {FORMAT_SQL.replace('clean_text', 'r.clean_text').replace('raw_text', 'r.raw_text')}
      WHEN 'char_count' THEN r.clean_text <> {s} AND length(r.clean_text) BETWEEN p.min_chars AND p.max_chars
      WHEN 'keyword' THEN r.clean_text <> {s} AND contains(r.clean_text, p.keyword_answer)
      WHEN 'prohibited_word' THEN r.clean_text <> {s} AND NOT contains(r.clean_text, p.prohibited_word_answer)
    END AS is_valid
  FROM results r JOIN prompts p ON r.task = p.task AND r.prompt_id = p.prompt_id)"""


def scores_cte() -> str:
    return """scores AS (
  SELECT task, model, aspect, iter, CAST(count(*) AS BIGINT) AS n,
         CAST(count_if(is_valid) AS BIGINT) AS n_valid,
         CAST(count_if(is_valid IS NULL) AS BIGINT) AS n_undecided,
         CAST(count_if(is_valid) AS DOUBLE) / count(*) AS score
  FROM valid GROUP BY task, model, aspect, iter)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def gappy_ctes() -> tuple[str, str]:
    there = "(prompt_id * 7 + iter * 3 + model_idx) % 11 <> 0 AND (prompt_id + model_idx) % 17 <> 0"
    cols = "task, model, model_idx, aspect, iter"
    return (
        f"""gres AS (
  SELECT {cols}, prompt_id FROM results WHERE {there}
  UNION ALL SELECT {cols}, prompt_id FROM results WHERE {there} AND prompt_id % 5 = 0
  UNION ALL SELECT {cols}, prompt_id + 1000000000 FROM results WHERE prompt_id % 13 = 0 AND iter = 0)""",
        """gprompts AS (
  SELECT task, prompt_id FROM prompts UNION ALL SELECT task, prompt_id FROM prompts WHERE prompt_id % 19 = 0
  UNION ALL SELECT task, NULL FROM prompts WHERE prompt_id % 23 = 0)""",
    )


def ctg_scores() -> str:
    return with_(prompts_cte(), results_cte(), valid_cte(), scores_cte()) + "SELECT * FROM scores"


# ---------------------------------------------------------------- more views

from .functions.templates import parts as _tparts  # noqa: E402
from .operators import chat as _CH  # noqa: E402
from .operators import clean as _CL  # noqa: E402
from .operators import prompts as _P  # noqa: E402
from .schemas import ASSISTANT_SYSTEM, BOARD_PREFIX, CTG_REPORT_LABELS  # noqa: E402
from .sources.fixtures import REGISTRY  # noqa: E402

KEYS = "task, model, prompt_id, aspect, iter"


def render_sql(template: str, values: dict[str, str]) -> str:
    pieces = []
    for literal, slot in _tparts(template):
        if literal:
            pieces.append(q(literal))
        if slot is not None:
            pieces.append(f"({values[slot]})")
    return " || ".join(pieces) if pieces else "''"


def render_by_sql(key: str, templates: dict, values: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {render_sql(t, values)}" for k, t in templates.items()) + f" ELSE {default} END"


def fmt3(x: str) -> str:
    return f"format('{{:.3f}}', {x})"


def round3(x: str) -> str:
    return f"CAST({fmt3(x)} AS DOUBLE)"


def task_prompt_sql(lmt: str, base: str, task: str = "task") -> str:
    return render_by_sql(task, _P.TASK_PROMPTS, {"lmt": lmt, "base_text": base})


def prompts_full_cte() -> str:
    cols = ", ".join(f"{task_prompt_sql(a, 'base_text')} AS prompt_{a}" for a in ASPECTS)
    return f"pfull AS (SELECT *, {cols} FROM prompts)"


def tprompts_cte() -> str:
    sel = " UNION ALL ".join(
        f"SELECT task, prompt_id, base_text, {q(a)} AS aspect, CAST({a} AS VARCHAR) AS constraint_text FROM prompts" for a in ASPECTS
    )
    return f"""clong AS ({sel}),
tprompts AS (SELECT task, prompt_id, aspect, {task_prompt_sql('constraint_text', 'base_text')} AS prompt FROM clong)"""


def chat_sql(family: str, text: str, use_system: str) -> str:
    vals = {"text": text, "bos": q(_CH.DEFAULT_BOS)}
    out = "CASE"
    for name, (on, off) in _CH.CHAT_TEMPLATES.items():
        out += f" WHEN {family} = {q(name)} THEN CASE WHEN {use_system} THEN {render_sql(on, vals)} ELSE {render_sql(off, vals)} END"
    return out + " END"


def family_sql(model_path: str) -> str:
    return "CASE " + " ".join(f"WHEN {model_path} = {q(k)} THEN {q(v)}" for k, v in _CH.RENDERER.items()) + " END"


def loader_sql(model_path: str) -> str:
    out = "CASE " + " ".join(f"WHEN contains({model_path}, {q(p)}) THEN {q(f)}" for p, f in _CH.LOADER_RULES)
    out += " " + " ".join(f"WHEN {model_path} = {q(k)} THEN {q(v)}" for k, v in _CH.LOADER_EXACT.items())
    return out + " END"


def requests_cte(models: list[tuple[int, str]], name: str = "requests") -> str:
    lit = "[" + ", ".join(
        f"{{'model_idx': {i}, 'model_path': {q(p)}, 'model': {q(suffix_py(p))}, 'iter': {it}}}" for i, p in models for it in range(3)
    ) + "]"
    return f"""{name} AS (
  SELECT task, prompt_id, aspect, prompt, CAST(c.model_idx AS INTEGER) AS model_idx, c.model_path AS model_path, c.model AS model,
         CAST(c.iter AS INTEGER) AS iter
  FROM (SELECT *, unnest({lit}) AS c FROM tprompts))"""


def chat_requests_cte() -> str:
    return f"""chatreq AS (
  SELECT *, {family_sql('model_path')} AS family, {chat_sql(family_sql('model_path'), 'prompt', 'true')} AS chat
  FROM requests)"""


def answers_cte() -> str:
    pi = "(prompt_id + iter)"
    return f"""answers AS (
  SELECT {TASK_OF} AS task, prompt_id, iter,
    CASE WHEN quality = 1 THEN CASE WHEN {pi} % 4 = 0 THEN '適 切' || chr(10) ELSE '適切' END
         WHEN quality = 0 THEN '不適切' ELSE '適切です' END AS answer,
    CASE WHEN {pi} % 5 < 2 THEN ' True' WHEN {pi} % 5 < 4 THEN 'False' WHEN {pi} % 10 = 4 THEN '判定, "でき' || chr(39) || chr(92) || 'ま' || chr(13) || 'せん' ELSE '判定できません' END AS answer_bool
  FROM (SELECT d.doc_id AS prompt_id, l.quality, CAST(unnest([0, 1, 2]) AS INTEGER) AS iter
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x)"""


def judged_cte() -> str:
    return f"""j0 AS (
  SELECT r.task, r.model, r.prompt_id, r.aspect, r.iter, a.answer, a.answer_bool,
    CASE {nb('a.answer')} WHEN '適切' THEN true WHEN '不適切' THEN false END AS l1,
    CASE {nb('a.answer_bool')} WHEN 'True' THEN true WHEN 'False' THEN false END AS l2
  FROM results r JOIN answers a ON r.task = a.task AND r.prompt_id = a.prompt_id AND r.iter = a.iter),
judged AS (
  SELECT {KEYS}, answer, answer_bool, l1, CASE WHEN l1 IS NULL THEN l2 END AS l2b,
    coalesce(l1, CASE WHEN l1 IS NULL THEN l2 END) AS ok,
    CASE WHEN l1 IS NOT NULL THEN 'first' WHEN l2 IS NOT NULL THEN 'fallback' ELSE 'unparsed' END AS stage,
    CASE WHEN l1 IS NULL AND l2 IS NULL THEN {nb('answer_bool')} END AS raw
  FROM j0)"""


def quality_cte() -> str:
    return """quality AS (
  SELECT task, model, aspect, iter, CAST(count(ok) AS BIGINT) AS n, CAST(count_if(ok) AS BIGINT) AS n_ok,
         CAST(count_if(ok IS NULL) AS BIGINT) AS n_unparsed, CAST(count_if(stage = 'fallback') AS BIGINT) AS n_fallback,
         CASE WHEN count(ok) = 0 THEN NULL ELSE CAST(count_if(ok) AS DOUBLE) / count(ok) END AS acc
  FROM judged GROUP BY task, model, aspect, iter),
qpiv AS (
  SELECT task, model, aspect,
    max(acc) FILTER (WHERE iter = 0) AS acc0, max(acc) FILTER (WHERE iter = 1) AS acc1, max(acc) FILTER (WHERE iter = 2) AS acc2,
    max(n_ok) FILTER (WHERE iter = 0) AS k0, max(n_ok) FILTER (WHERE iter = 1) AS k1, max(n_ok) FILTER (WHERE iter = 2) AS k2,
    max(n) FILTER (WHERE iter = 0) AS n0, max(n) FILTER (WHERE iter = 1) AS n1, max(n) FILTER (WHERE iter = 2) AS n2
  FROM quality GROUP BY task, model, aspect),
allacc AS (SELECT task, model, aspect, (acc0 + acc1 + acc2) / 3 AS all_acc FROM qpiv)"""


def ctg_lines_cte() -> str:
    order = "CASE aspect " + " ".join(f"WHEN {q(a)} THEN {i}" for i, a in enumerate(ASPECTS)) + " END"
    label = "CASE aspect " + " ".join(f"WHEN {q(a)} THEN {q(CTG_REPORT_LABELS[a])}" for a in ASPECTS) + " END"
    return f"""ctglines AS (
  SELECT task, model, iter, CAST({order} AS INTEGER) AS line_no, {label} || ': ' || {fmt3('score')} AS line FROM scores)"""


def qlines_cte() -> str:
    order = "CASE aspect " + " ".join(f"WHEN {q(a)} THEN {i}" for i, a in enumerate(ASPECTS)) + " END"
    base = f"(2 + 6 * ({order}))"
    parts = [
        "SELECT task, model, CAST(0 AS INTEGER) AS line_no, 'Model: ' || model AS line FROM datanum",
        "SELECT task, model, CAST(1 AS INTEGER), 'Data Num: ' || CAST(data_num AS VARCHAR) FROM datanum",
        f"SELECT task, model, CAST({base} AS INTEGER), '【' || aspect || '_wo_hf】' FROM qpiv",
    ]
    for i in range(3):
        parts.append(
            f"SELECT task, model, CAST({base} + {i + 1} AS INTEGER), 'iter{i}-Acc: ' || {fmt3(f'acc{i}')} || ' (' || CAST(k{i} AS VARCHAR) || ' / ' || CAST(n{i} AS VARCHAR) || ')' FROM qpiv"
        )
    parts.append(f"SELECT task, model, CAST({base} + 4 AS INTEGER), 'All-Acc: ' || {fmt3('(acc0 + acc1 + acc2) / 3')} FROM qpiv")
    parts.append(f"SELECT task, model, CAST({base} + 5 AS INTEGER), '' FROM qpiv")
    return f"""datanum AS (SELECT task, model, CAST(count(DISTINCT prompt_id) AS BIGINT) AS data_num FROM results GROUP BY task, model),
qlines AS ({' UNION ALL '.join(parts)})"""


def board_cte() -> str:
    return f"""cmean AS (
  SELECT task, model, aspect,
    (max({round3('score')}) FILTER (WHERE iter = 0) + max({round3('score')}) FILTER (WHERE iter = 1)
     + max({round3('score')}) FILTER (WHERE iter = 2)) / 3 AS ctg
  FROM scores GROUP BY task, model, aspect),
bw AS (
  SELECT c.task, c.model,
    {', '.join(f"max(c.ctg) FILTER (WHERE c.aspect = {q(a)}) AS {a}_ctg, max({round3('a.all_acc')}) FILTER (WHERE c.aspect = {q(a)}) AS {a}_qual" for a in ASPECTS)}
  FROM cmean c JOIN allacc a ON c.task = a.task AND c.model = a.model AND c.aspect = a.aspect
  GROUP BY c.task, c.model),
bavg AS (
  SELECT *, ({' + '.join(f'{a}_ctg' for a in ASPECTS)}) / 4 AS avg_ctg, ({' + '.join(f'{a}_qual' for a in ASPECTS)}) / 4 AS avg_qual FROM bw)"""


def clean_sql(text: str = "raw_text", task: str = "task") -> str:
    out = "CASE"
    for name, (o, c) in _CL.rule_patterns().items():
        x = text
        if o:
            x = f"regexp_replace({x}, {q(o)}, '')"
        if c:
            x = f"regexp_replace({x}, {q(c)}, '')"
        out += f" WHEN {task} = {q(name)} THEN {x}"
    return f"CASE WHEN {text} = {q(SENTINEL)} THEN {text} ELSE {out} ELSE {text} END END"


def md5len(x: str, name: str) -> str:
    return f"md5({x}) AS {name}_md5, length({x}) AS {name}_len"


BASE = [prompts_cte(), results_cte()]


def sql(*ctes: str, select: str) -> str:
    return with_(*BASE, *ctes) + select


def build() -> dict[str, str]:
    V = [valid_cte()]
    S_ = [valid_cte(), scores_cte()]
    QJ = [answers_cte(), judged_cte()]
    Q = QJ + [quality_cte()]
    TP = [tprompts_cte()]
    GEN = TP + [requests_cte(generated_models())]
    ALLREQ = TP + [requests_cte(list(enumerate(REGISTRY)))]
    sep = "'␞'"
    base_join = "FROM results r JOIN prompts p ON r.task = p.task AND r.prompt_id = p.prompt_id"
    rk = "r.task, r.model, r.prompt_id, r.aspect, r.iter"
    out = {}
    out["src_prompt_master"] = sql(prompts_full_cte(), select=f"""SELECT task, prompt_id, title, {md5len('base_text', 'base_text')}, format, char_count, keyword,
      prohibited_word, min_chars, max_chars, keyword_answer, prohibited_word_answer,
      {', '.join(md5len(f'prompt_{a}', f'prompt_{a}') for a in ASPECTS)} FROM pfull""")
    out["src_results"] = sql(select=f"SELECT task, model_path, model, prompt_id, aspect, iter, {md5len('raw_text', 'raw_text')} FROM results")
    out["src_results_clean"] = sql(
        select=f"SELECT task, model_path, model, prompt_id, aspect, iter, {md5len('raw_text', 'raw_text')}, {md5len('clean_text', 'clean_text')} FROM results"
    )
    out["read_ctg_report"] = sql(*S_, select=f"SELECT task, model, iter, aspect, {round3('score')} AS score FROM scores")
    out["read_quality_report"] = sql(*Q, select=f"SELECT task, model, CAST(4 AS INTEGER) AS n_values, aspect, {round3('all_acc')} AS all_acc FROM allacc")
    out["parse_bool_list"] = sql(*QJ, select=f"SELECT {KEYS}, ok FROM judged")
    out["list_models"] = sql(select="SELECT DISTINCT task, model_path, model FROM results")
    reg = "[" + ", ".join(f"{{'model_path': {q(p)}, 'model': {q(suffix_py(p))}}}" for p in REGISTRY) + "]"
    out["missing_inputs"] = sql(
        select=f"""SELECT e.task, e.model, e.model_path FROM (SELECT task, m.model_path AS model_path, m.model AS model
          FROM (SELECT task, unnest({reg}) AS m FROM (SELECT DISTINCT task FROM prompts))) e
        WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.task = e.task AND r.model = e.model)"""
    )
    out["constraints_long"] = sql(*TP, select="SELECT task, prompt_id, aspect, constraint_text FROM clong")
    out["task_prompts"] = sql(*TP, select=f"SELECT task, prompt_id, aspect, {md5len('prompt', 'prompt')} FROM tprompts")
    cp = render_by_sql("task", _P.CLEAN_PROMPTS, {"generated_result": "raw_text"}, "''")
    out["clean_prompts"] = sql(select=f"SELECT {KEYS}, {md5len(cp, 'prompt')} FROM results")
    for key, tpl in (("judge_prompts", _P.JUDGE_PROMPTS), ("judge_prompts_bool", _P.JUDGE_BOOL_PROMPTS)):
        jp = render_by_sql("r.task", tpl, {"generated_result": "r.clean_text", "base_text": "p.base_text"}, "''")
        out[key] = sql(select=f"SELECT {rk}, {md5len(jp, 'prompt')} {base_join}")
    fams = "[" + ", ".join(f"{{'family': {q(f)}, 'use_system': {'true' if u else 'false'}}}" for f in _CH.FAMILIES for u in (True, False)) + "]"
    sysq = f"CASE WHEN c.family = 'openai' THEN CASE WHEN c.use_system THEN {q(ASSISTANT_SYSTEM)} ELSE '' END END"
    out["chat_prompts"] = sql(
        *TP,
        select=f"""SELECT task, prompt_id, aspect, c.family AS family, c.use_system AS use_system, {sysq} AS system,
          {md5len(chat_sql('c.family', 'prompt', 'c.use_system'), 'chat')} FROM (SELECT *, unnest({fams}) AS c FROM tprompts)""",
    )
    sup = f"({loader_sql('model_path')} IS NOT NULL AND {family_sql('model_path')} IS NOT NULL)"
    out["route_family"] = sql(
        *ALLREQ,
        select=f"""SELECT model_path, {loader_sql('model_path')} AS loader_family, {family_sql('model_path')} AS family, {sup} AS supported,
          CAST(count(*) AS BIGINT) AS n_requests FROM requests GROUP BY ALL""",
    )
    out["unsupported_models"] = sql(
        *ALLREQ,
        select=f"""SELECT model_path, {loader_sql('model_path')} AS loader_family, {family_sql('model_path')} AS family,
          CAST(count(*) AS BIGINT) AS n_requests FROM requests WHERE NOT {sup} GROUP BY ALL""",
    )

    def param(k, t):
        return "CASE family " + " ".join(
            f"WHEN {q(f)} THEN CAST({('NULL' if p[k] is None else (str(p[k]).lower() if isinstance(p[k], bool) else repr(p[k])))} AS {t})"
            for f, p in _CH.GEN_PARAMS.items()
        ) + " END"

    out["gen_params"] = sql(
        *TP, requests_cte(list(enumerate(_CH.RENDERER))), f"chatreq AS (SELECT model_path, {family_sql('model_path')} AS family FROM requests)",
        select=f"""SELECT model_path, family, CAST(count(*) AS BIGINT) AS n_requests, {param('do_sample', 'BOOLEAN')} AS do_sample,
          {param('temperature', 'DOUBLE')} AS temperature, {param('top_p', 'DOUBLE')} AS top_p, {param('top_k', 'INTEGER')} AS top_k,
          {param('repetition_penalty', 'DOUBLE')} AS repetition_penalty, {param('num_beams', 'INTEGER')} AS num_beams, CAST(CASE WHEN family IN ({', '.join(q(f) for f in _CH.GEN_PARAMS)}) THEN {_CH.MAX_NEW_TOKENS} END AS INTEGER) AS max_new_tokens
          FROM chatreq GROUP BY model_path, family""",
    )
    out["strip_echo"] = sql(*TP, select="SELECT task, prompt_id, aspect, chr(10) || '応答(' || CAST(length(prompt) AS VARCHAR) || ')' AS text FROM tprompts")
    out["gen_requests"] = sql(
        *GEN, chat_requests_cte(),
        select=f"""SELECT {KEYS}, model_path, family, true AS use_system, {md5len('chat', 'chat')},
          {param('temperature', 'DOUBLE')} AS temperature, {param('top_p', 'DOUBLE')} AS top_p FROM chatreq""",
    )
    out["gen_run"] = sql(
        *GEN, chat_requests_cte(),
        select=f"SELECT {KEYS}, chr(10) || '応答(' || CAST(length(chat) AS VARCHAR) || ')' AS text, CAST(NULL AS VARCHAR) AS error FROM chatreq",
    )
    gm = "[" + ", ".join(f"{{'pos': {pos}, 'model_path': {q(p)}, 'model': {q(suffix_py(p))}}}" for pos, (_, p) in enumerate(generated_models())) + "]"
    out["gen_ids"] = sql(
        select=f"""SELECT task, m.model_path AS model_path, m.model AS model, prompt_id,
          CAST(m.pos * n + rk - 1 AS BIGINT) AS generated_text_id
        FROM (SELECT task, prompt_id, count(*) OVER (PARTITION BY task) AS n,
                     row_number() OVER (PARTITION BY task ORDER BY prompt_id) AS rk, unnest({gm}) AS m FROM prompts)"""
    )
    out["dead_letters"] = sql(
        *GEN, chat_requests_cte(),
        select=f"SELECT {KEYS}, 'RetryableError: overloaded' AS error, CAST(3 AS INTEGER) AS attempts FROM chatreq WHERE length(chat) % 11 = 0",
    )
    out["gen_errors"] = sql(
        *GEN, chat_requests_cte(),
        select=f"SELECT {KEYS}, CASE WHEN length(chat) % 11 = 0 THEN 'RetryableError: overloaded' ELSE 'ok:' || CAST(length(chat) AS VARCHAR) END AS text FROM chatreq",
    )
    wcols = ", ".join(
        f"CAST(count(*) FILTER (WHERE aspect = {q(a)}) AS INTEGER) AS {a}_n, "
        f"md5(string_agg(raw_text, {sep} ORDER BY iter) FILTER (WHERE aspect = {q(a)})) AS {a}_md5, "
        f"md5(string_agg(clean_text, {sep} ORDER BY iter) FILTER (WHERE aspect = {q(a)})) AS {a}_wo_hf_md5"
        for a in ASPECTS
    )
    out["wide_results"] = sql(select=f"SELECT task, model, prompt_id, {wcols} FROM results GROUP BY task, model, prompt_id")
    out["pending_requests"] = sql(select=f"SELECT {KEYS} FROM results WHERE clean_text = {q(SENTINEL)}")
    out["layout_master"] = sql(
        select=f"SELECT task, prompt_id, title, {md5len('base_text', 'base_text')}, format, char_count, keyword, prohibited_word, [min_chars, max_chars] AS char_count_answer, keyword_answer, prohibited_word_answer, CAST(NULL AS VARCHAR) AS _corrupt_record FROM prompts"
    )
    short = f"""short AS (SELECT task, model, model_path, prompt_id, aspect, iter, chr(9) || '"{{' || md5(body) || '}}' || chr(92) || chr(10) || '要約' || chr(13) || chr(39) || iter AS raw_text,
      CASE WHEN iter = 1 THEN {q(SENTINEL)} ELSE md5(body) END AS clean_text FROM gen2)"""
    first = q(suffix_py(generated_models()[0][1]))
    out["layout_results"] = sql(short, select=f"SELECT {KEYS}, model_path, raw_text FROM short")
    out["layout_results_clean"] = sql(short, select=f"SELECT {KEYS}, raw_text, clean_text FROM short WHERE task = {q(TASKS[1])} AND model = {first}")
    out["layout_models"] = sql(select=f"SELECT DISTINCT task, model FROM results WHERE model = {first} OR task = {q(TASKS[0])}")
    out["layout_ctg_reports"], out["layout_quality_reports"] = out["read_ctg_report"], out["read_quality_report"]
    out["gen_resume"] = sql(*GEN, chat_requests_cte(), select=f"SELECT {KEYS}, CAST(1 AS BIGINT) AS n_answers, 'ok:' || CAST(length(chat) AS VARCHAR) AS text FROM chatreq")
    combos = lambda models: "[" + ", ".join(f"{{'model': {q(suffix_py(p))}, 'aspect': {q(a)}, 'iter': {i}}}" for _, p in models for a in ASPECTS for i in range(3)) + "]"
    asked = "asked AS (SELECT task, prompt_id, CAST(c.model AS VARCHAR) AS model, CAST(c.aspect AS VARCHAR) AS aspect, CAST(c.iter AS INTEGER) AS iter FROM (SELECT task, prompt_id, unnest({}) AS c FROM (SELECT DISTINCT task, prompt_id FROM gprompts WHERE prompt_id IS NOT NULL)))"
    out["pending_bitmaps"] = sql(
        *gappy_ctes(), asked.format(combos(generated_models())),
        select=f"SELECT {KEYS} FROM asked a WHERE NOT EXISTS (SELECT 1 FROM gres r WHERE r.task = a.task AND r.model = a.model AND r.prompt_id = a.prompt_id AND r.aspect = a.aspect AND r.iter = a.iter)",
    )
    out["key_fill"] = sql(
        *gappy_ctes(), asked.format(combos(list(enumerate(REGISTRY)))),
        select="""SELECT a.task, a.model, a.aspect, a.iter, CAST(count(*) AS BIGINT) AS n_prompts, CAST(count(r.task) AS BIGINT) AS n_held
          FROM asked a LEFT JOIN (SELECT DISTINCT task, model, prompt_id, aspect, iter FROM gres) r
          ON r.task = a.task AND r.model = a.model AND r.prompt_id = a.prompt_id AND r.aspect = a.aspect AND r.iter = a.iter GROUP BY ALL""",
    )
    cut = r"'[^.。．!！?？\n]*[.。．!！?？\n]+|[^.。．!！?？\n]+'"
    # six levels are more than any of the fixture's texts share
    parts = {"header": "array_to_string(u[1:k], '')", "footer": "array_to_string(u[len(u) - k + 1:], '')"}
    edge_ctes = (
        f"et AS MATERIALIZED (SELECT DISTINCT task, model, prompt_id, raw_text, regexp_extract_all(raw_text, {cut}) AS u FROM results)",
        "ek AS (SELECT et.*, k FROM et, range(1, 7) r(k) WHERE k < len(u))",
        "ee AS (SELECT task, model, greatest(10, ceil(count(DISTINCT prompt_id) * 0.05)) AS enough FROM et GROUP BY task, model)",
        "en AS MATERIALIZED (SELECT x.*, enough FROM ("
        + " UNION ALL ".join(f"SELECT task, model, '{side}' AS side, CAST(k AS INTEGER) AS level, {t} AS text, count(DISTINCT prompt_id) AS n_prompts FROM ek GROUP BY ALL" for side, t in parts.items())
        + ") x JOIN ee USING (task, model) WHERE n_prompts >= enough)",
        "ed AS (SELECT task, model, prompt_id, raw_text, u, max(k) FILTER (side = 'header') AS h, max(k) FILTER (side = 'footer') AS f FROM ("
        + " UNION ALL ".join(f"SELECT ek.*, en.side FROM ek JOIN en ON ek.task = en.task AND ek.model = en.model AND ek.k = en.level AND en.side = '{side}' AND en.text = {t}" for side, t in parts.items())
        + ") GROUP BY ALL)",
        "ec AS (SELECT et.task, et.model, et.prompt_id, et.raw_text, et.u, coalesce(h, 0) AS h, least(coalesce(f, 0), len(et.u) - coalesce(h, 0) - 1) AS f FROM et LEFT JOIN ed USING (task, model, prompt_id, raw_text))",
        "ey AS (SELECT *, array_to_string(u[h + 1:len(u) - f], '') AS kept FROM ec)",
        r"ez AS (SELECT *, CASE WHEN h > 0 THEN regexp_replace(kept, '^[ \t\r\n　]+', '') ELSE kept END AS cut FROM ey)",
        r"ex AS (SELECT task, model, prompt_id, raw_text, CASE WHEN len(u) = 0 THEN raw_text WHEN f > 0 THEN regexp_replace(cut, '[ \t\r\n　]+$', '') ELSE cut END AS clean FROM ez)",
    )
    out["edge_phrases"] = sql(*edge_ctes, select="SELECT task, model, side, level, CAST(n_prompts AS BIGINT) AS n_prompts, text FROM en")
    out["clean_discovered"] = sql(*edge_ctes, select=f"SELECT {', '.join('r.' + c for c in KEYS.split(', '))}, {md5len('clean', 'clean_text')} FROM results r JOIN ex USING (task, model, prompt_id, raw_text)")
    out["clean_run"] = sql(select=f"SELECT {KEYS}, {md5len(clean_sql(), 'clean_text')}, CAST(NULL AS VARCHAR) AS error FROM results")
    out["clean_rules"] = sql(select=f"SELECT {KEYS}, {md5len(clean_sql(), 'clean_text')} FROM results")
    ccols = ", ".join(
        f"md5(string_agg({clean_sql()}, {sep} ORDER BY iter) FILTER (WHERE aspect = {q(a)})) AS {a}_wo_hf_md5" for a in ASPECTS
    )
    out["clean_wide"] = sql(select=f"SELECT task, model, prompt_id, {ccols} FROM results GROUP BY task, model, prompt_id")
    out["delete_blank"] = sql(select=f"SELECT {KEYS}, {md5len(nb('clean_text'), 'clean_nb')} FROM results")
    for a in ASPECTS:
        out[f"valid_{a}"] = sql(*V, select=f"SELECT task, model, prompt_id, iter, is_valid FROM valid WHERE aspect = {q(a)}")
    out["explode_iterations"] = sql(select=f"SELECT {KEYS}, {md5len('raw_text', 'raw_text')}, {md5len('clean_text', 'clean_text')} FROM results")
    out["valid_all"] = sql(*V, select=f"SELECT {KEYS}, is_valid FROM valid")
    out["ctg_scores"] = sql(*S_, select="SELECT * FROM scores")
    acols = []
    for a in ["char_count", "keyword", "prohibited_word", "format"]:
        f = f"v.aspect = {q(a)}"
        acols.append(
            f"max(p.{a}) AS {a}, max(md5(v.raw_text)) FILTER (WHERE {f}) AS {a}_result_md5, "
            f"max(md5(v.clean_text)) FILTER (WHERE {f}) AS {a}_result_wo_hf_md5, bool_or(v.is_valid) FILTER (WHERE {f}) AS is_valid_{a}"
        )
    out["analysis_rows"] = sql(
        *V,
        select=f"""SELECT v.task, v.model, v.iter, v.prompt_id, max(p.title) AS title, max(md5(p.base_text)) AS base_text_md5, {', '.join(acols)}
          FROM valid v JOIN prompts p ON v.task = p.task AND v.prompt_id = p.prompt_id GROUP BY v.task, v.model, v.iter, v.prompt_id""",
    )
    out["ctg_report_lines"] = sql(*S_, ctg_lines_cte(), select="SELECT * FROM ctglines")
    out["coverage"] = sql(
        *gappy_ctes(),
        select="""SELECT task, model, 'result_without_prompt' AS kind, CAST(count(*) AS BIGINT) AS n
          FROM (SELECT DISTINCT task, model, prompt_id FROM gres) r
          WHERE NOT EXISTS (SELECT 1 FROM gprompts p WHERE p.task = r.task AND p.prompt_id = r.prompt_id) GROUP BY task, model
        UNION ALL
        SELECT m.task, m.model, 'prompt_without_result', CAST(count(*) AS BIGINT)
          FROM (SELECT DISTINCT task, model FROM gres) m JOIN gprompts p ON p.task = m.task
          WHERE NOT EXISTS (SELECT 1 FROM gres r WHERE r.task = m.task AND r.model = m.model AND r.prompt_id = p.prompt_id)
          GROUP BY m.task, m.model"""
    )
    out["master_key_issues"] = sql(
        *gappy_ctes(),
        select="""SELECT task, prompt_id, CAST(count(*) AS BIGINT) AS n,
          CASE WHEN prompt_id IS NULL OR task IS NULL THEN 'null_key' ELSE 'duplicate_key' END AS issue
          FROM gprompts GROUP BY task, prompt_id HAVING prompt_id IS NULL OR task IS NULL OR count(*) > 1"""
    )
    out["judged_columns"] = sql(
        select=f"SELECT task, model, prompt_id, aspect || '_wo_hf' AS label, iter, {md5len('clean_text', 'text')} FROM results"
    )
    j1 = render_by_sql("r.task", _P.JUDGE_PROMPTS, {"generated_result": "r.clean_text", "base_text": "p.base_text"}, "''")
    j2 = render_by_sql("r.task", _P.JUDGE_BOOL_PROMPTS, {"generated_result": "r.clean_text", "base_text": "p.base_text"}, "''")
    out["judge_run"] = sql(
        f"jr AS (SELECT {rk}, length({j1}) % 3 AS a, length({j2}) % 3 AS b {base_join})",
        select=f"""SELECT {KEYS},
          CASE WHEN a = 0 THEN true WHEN a = 1 THEN false WHEN b = 0 THEN true WHEN b = 1 THEN false END AS ok,
          CASE WHEN a < 2 THEN 'first' WHEN b < 2 THEN 'fallback' ELSE 'unparsed' END AS stage,
          CASE WHEN a = 2 AND b = 2 THEN 'わからない' END AS raw FROM jr""",
    )
    out["judge_normalise"] = sql(*QJ, select=f"SELECT {KEYS}, {nb('answer')} AS answer_nb FROM judged")
    out["judge_label"] = sql(*QJ, select=f"SELECT {KEYS}, l1 AS label FROM judged")
    out["judge_fallback"] = sql(*QJ, select=f"SELECT {KEYS}, ok, stage FROM judged WHERE stage <> 'first'")
    out["judge_unparsed"] = sql(*QJ, select=f"SELECT {KEYS}, raw FROM judged WHERE stage = 'unparsed'")
    elem = "CASE WHEN ok THEN 'True' WHEN NOT ok THEN 'False' ELSE chr(39) || replace(replace(replace(coalesce(raw, ''), chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)), chr(13), chr(92) || 'r') || chr(39) END"
    cells = ", ".join(
        f"'[' || string_agg({elem}, ', ' ORDER BY iter) FILTER (WHERE aspect = {q(a)}) || ']' AS {a}_wo_hf" for a in ASPECTS
    )
    out["judge_table"] = sql(
        *QJ,
        f"jt AS (SELECT task, model, prompt_id, {cells} FROM judged GROUP BY task, model, prompt_id)",
        select=f"""SELECT jt.*, CAST(x.m.pos * n + rk - 1 AS BIGINT) AS generated_text_id FROM jt JOIN
          (SELECT task, prompt_id, count(*) OVER (PARTITION BY task) AS n, row_number() OVER (PARTITION BY task ORDER BY prompt_id) AS rk,
                  unnest({gm}) AS m FROM prompts) x
          ON jt.task = x.task AND jt.prompt_id = x.prompt_id AND jt.model = x.m.model""",
    )
    said = f"""CASE WHEN a.answer_bool IN (' True', 'False') THEN a.answer_bool
      ELSE a.answer_bool || chr(92) || chr(39) || '　"' || d.text END"""
    out["judge_cells"] = sql(
        answers_cte(),
        f"""said AS (SELECT a.task, a.prompt_id, a.iter, {nb('a.answer')} AS first, {nb(said)} AS second
          FROM answers a JOIN documents d ON a.prompt_id = d.doc_id)""",
        """cells AS (SELECT task, prompt_id, iter, CASE WHEN first = '適切' THEN true WHEN first = '不適切' THEN false
            WHEN second = 'True' THEN true WHEN second = 'False' THEN false END AS ok,
          CASE WHEN first NOT IN ('適切', '不適切') AND second NOT IN ('True', 'False') THEN second END AS raw FROM said)""",
        select=f"""SELECT task, prompt_id, iter, CASE WHEN ok IS NOT NULL THEN 'BOOLEAN' WHEN raw IS NOT NULL THEN 'STRING' ELSE 'VOID' END AS kind,
          ok, {md5len('raw', 'raw')} FROM cells""",
    )
    out["judge_cells_scored"] = sql(
        *QJ,
        select="""SELECT task, model, aspect, iter, CAST(count(ok) AS BIGINT) AS n, CAST(count_if(ok) AS BIGINT) AS n_ok,
          CAST(count_if(ok IS NULL) AS BIGINT) AS n_unparsed, count_if(ok) / nullif(count(ok), 0) AS acc,
          CAST(count(*) AS BIGINT) AS n_all, CAST(count_if(coalesce(ok, coalesce(raw, '') <> '')) AS BIGINT) AS n_true
          FROM judged GROUP BY task, model, aspect, iter""",
    )
    out["quality_scores"] = sql(*Q, select="SELECT * FROM quality")
    out["quality_all_acc"] = sql(*Q, select="SELECT * FROM allacc")
    out["quality_report_lines"] = sql(*Q, qlines_cte(), select="SELECT * FROM qlines")
    out["ctg_mean_rounded"] = sql(*S_, *Q, board_cte(), select="SELECT task, model, aspect, ctg AS ctg_mean FROM cmean")
    out["leaderboard_wide"] = sql(*S_, *Q, board_cte(), select="SELECT * FROM bw")
    out["leaderboard_avg"] = sql(*S_, *QJ, quality_cte(), board_cte(), select="SELECT task, model, avg_ctg, avg_qual FROM bavg")
    bcols = ", ".join(
        f"{fmt3(f'{a}_ctg')} AS \"{BOARD_PREFIX[a]}-ctg\", {fmt3(f'{a}_qual')} AS \"{BOARD_PREFIX[a]}-qual\"" for a in ASPECTS
    )
    out["leaderboard"] = sql(
        *S_, *QJ, quality_cte(), board_cte(),
        select=f"SELECT task, model, {bcols}, {fmt3('avg_ctg')} AS \"Avg-ctg\", {fmt3('avg_qual')} AS \"Avg-qual\" FROM bavg",
    )
    out["incomplete_scores"] = sql(
        *S_, *QJ, quality_cte(),
        select="""SELECT coalesce(c.task, q.task) AS task, coalesce(c.model, q.model) AS model, c.ctg_lines, q.quality_values FROM
          (SELECT task, model, CAST(count(*) AS BIGINT) AS ctg_lines, count(DISTINCT iter) AS n_iters FROM scores
           WHERE NOT (model = '{second}' AND task = '{t0}' AND iter = 1 AND aspect = '{a0}') AND NOT (model <> '{second}' AND task = '{t1}' AND iter = 2) GROUP BY task, model) c
          FULL JOIN (SELECT task, model, CAST(count(*) AS BIGINT) AS quality_values FROM allacc
           WHERE NOT (model = '{second}' AND task = '{t2}' AND aspect = '{a1}') AND NOT (model <> '{second}' AND task = '{t2}') GROUP BY task, model) q
          ON c.task = q.task AND c.model = q.model
          WHERE c.ctg_lines IS NULL OR q.quality_values IS NULL OR c.ctg_lines <> 12 OR c.n_iters <> 3 OR q.quality_values <> 4""".format(
            second=suffix_py(generated_models()[1][1]), t0=TASKS[0], t1=TASKS[1], t2=TASKS[2], a0=ASPECTS[0], a1=ASPECTS[1]
        ),
    )
    return out
