"""DuckDB statements with the same results as the queries, where SQL can say it."""

from __future__ import annotations

from tessera.functions import answers
from tessera.functions import features as X
from tessera.functions.answers import NOTES
from tessera.functions.cleaning import BOILERPLATE, LINK
from tessera.functions.words import SPACES
from tessera.operators import preference, selection

SPACE = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACES)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


# --- features ------------------------------------------------------------------------------------------------

_BOILER = "(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE)


def features(table: str, key: str) -> str:
    """The features of a table's texts; letters beyond ASCII are made two letters where word ends count."""
    ascii_ = "regexp_replace(text, '[^\\x00-\\x7F\\PL]', 'QQ', 'g')"
    return f"""
  select {key}, length(text) as char_len,
    round(coalesce(list_sum(list_transform(regexp_extract_all(text, {q(LINK)}), lambda u: length(u))), 0) / greatest(length(text), 1), 4) as link_ratio,
    round(case when len(ls) > 0 then 1.0::double - len(list_distinct(ls)) / len(ls)::double else 0.0::double end, 4) as repeat_ratio,
    len(list_filter(ls, lambda l: {has('l', _BOILER)})) as boilerplate_hits,
    {count('text', X.SYMBOL)} as symbol_count, {count(ascii_, rf'\\(?:{X.COMMANDS})\b')} as latex_cmd_count, {count('text', X.NUMBER)} as number_count,
    len(list_filter(regexp_extract_all({ascii_}, {q(X.VARIABLE.replace('(?U)', ''))}, 1), lambda v: lower(v) <> 'a')) as variable_like_count,
    {count(ascii_, rf'(?i)\b(?:{X.KEYWORDS})\b')} + {count('text', X.KEYWORDS_ZH)} as math_keyword_count,
    {has('text', '(?i)' + X.PROBLEM)} as has_problem_solution_signal, {has('text', '(?i)' + X.PROOF)} as has_proof_signal
  from (select *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') as ls from {table} where text is not null)"""


def _steps(c: str, *steps: tuple[float, float]) -> str:
    return "case " + " ".join(f"when {c} >= {t} then {a}" for t, a in steps) + " else 0 end::double"


_BARE = "latex_cmd_count = 0 and (math_keyword_count >= 1 or number_count >= 3)"
_PARTS = [
    _steps("latex_cmd_count", (5, 1.0), (3, 0.8), (1, 0.4)), _steps("math_keyword_count", (4, 0.6), (2, 0.5), (1, 0.2)), "case when has_problem_solution_signal then 0.4 else 0 end::double", "case when has_proof_signal then 0.3 else 0 end::double",
    _steps("number_count", (10, 0.3), (5, 0.2)), _steps("symbol_count", (10, 0.3), (5, 0.2)), _steps("variable_like_count", (8, 0.2)), "-" + _steps("boilerplate_hits", (5, 0.8), (3, 0.5), (1, 0.2)), "-" + _steps("link_ratio", (0.3, 0.6), (0.2, 0.4), (0.1, 0.2)),
    "-" + _steps("repeat_ratio", (0.4, 0.5), (0.3, 0.3)), "-case when char_len < 80 then 0.3 when char_len < 150 then 0.1 else 0 end::double", _steps("char_len", (500, 0.2)), _steps("char_len", (1000, 0.1)), f"case when {_BARE} and variable_like_count >= 3 then 0.3 else 0 end::double", f"case when {_BARE} and number_count >= 5 then 0.2 else 0 end::double",
]
_STRONG = "(latex_cmd_count >= 2 or math_keyword_count >= 2 or has_problem_solution_signal or has_proof_signal or symbol_count >= 5)"
_ANY = "(latex_cmd_count > 0 or math_keyword_count > 0 or symbol_count >= 2 or number_count >= 3 or variable_like_count >= 3)"
SCORES = f"""
select doc_id, score, case when score >= 4.2 or (score >= 3.8 and strong) then 'keep' when score < 2.8 and not strong then 'drop' else 'llm' end as route, strong, rewrite, dropped from (
  select doc_id, greatest(0.0, least(5.0, round(2.5::double + {' + '.join(_PARTS)}, 4))) as score, {_STRONG} as strong,
    (boilerplate_hits >= 2 or link_ratio >= 0.1 or repeat_ratio >= 0.15) and (latex_cmd_count >= 1 or math_keyword_count >= 1 or symbol_count >= 3) as rewrite,
    (char_len < 30 and not {_ANY}) or link_ratio > 0.5 or (boilerplate_hits > 5 and not {_ANY}) or (repeat_ratio > 0.6 and char_len < 100) as dropped
  from ({features('documents', 'doc_id')}))"""

# --- questions -----------------------------------------------------------------------------------------------

KEY_STRIP, KEY_RAW = strip("question[1:120]"), "question[1:120]"
QUESTIONS = "(select *, case when isnan(student_accuracy) then null else student_accuracy end as acc from dpo_questions_24k_v2)"


def classify(subjects: dict, excluded: dict) -> str:
    tests = [f"when {has('lower(question[1:500])', selection.quoted(w))} then {q(n)}" for n, w in [*excluded.items(), *subjects.items()]]
    return "case " + " ".join(tests) + f" else {q(selection.OTHER)} end"


LONG, SHORT = classify(selection.SUBJECTS, selection.EXCLUDED), classify(selection.SUBJECTS_SHORT, selection.EXCLUDED_SHORT)
VALID = f"coalesce(regexp_matches({strip('ground_truth')}, '^-?\\d+$|^-?\\d+\\.\\d{{1,6}}$|^-?\\d+/\\d+$'), false)"


def cascade(subject: str, excluded: dict, training: bool) -> str:
    names = ", ".join(map(q, excluded))
    early = (
        f"case when not {VALID} then 'reference_invalid' when length(question) < 50 then 'question_short' when length(question) > 1500 then 'question_long' when coalesce(length(answer), 0) < 100 then 'answer_short' end"
        if training
        else f"case when ground_truth is null then 'no_reference' when not {VALID} then 'reference_no_number' when length(answer) < 200 then 'answer_short' when length(answer) > 2000 then 'answer_long' when length(question) < 50 then 'question_short' when length(question) > 1500 then 'question_long' end"
    )
    right, out = "when acc >= 1 then 'all_correct'", f"when subject in ({names}) then 'excluded_subject'"
    late = f"{out} {right}" if training else f"{right} {out}"
    return f"""
select coalesce(early, case when row_idx > first then 'duplicate' {late} end, 'kept') as reason, count(*) as n from (
  select *, min(case when early is null then row_idx end) over (partition by qkey) as first from (
    select row_idx, acc, {KEY_STRIP} as qkey, {subject} as subject, {early} as early from {QUESTIONS})) group by all"""


def cases(values: dict, on: str, default: object) -> str:
    return f"case {on} " + " ".join(f"when {q(k)} then {v}" for k, v in values.items()) + f" else {default} end"


RESCUE = "case when acc is null then 'unknown' when acc between 0.1 and 0.5 then 'sweet_spot' when acc = 0 and {ok} then 'recoverable_hard' when acc > 0.5 and acc < 0.8 then 'medium_easy' when acc > 0 and acc < 0.1 then 'low_acc' else 'fallback' end"
PLAIN = "case when acc is null then 'unknown' when acc >= 1 then 'all_correct' when acc >= 0.5 then 'on_policy' when acc > 0 then 'mid_hard' else 'hard_zero' end"
START = "case when acc <= 0.05 then 'hard' when acc between 0.1 and 0.6 then 'sweet_mid' when acc >= 0.8 then 'easy' else 'exploration' end"
BIN = "case when acc is null then 'unknown' when acc = 0 then '0' when acc < 0.25 then '(0, .25)' when acc < 0.5 then '[.25, .5)' when acc < 0.75 then '[.5, .75)' else '[.75, 1]' end"


def uniform(seed: str, key: str) -> str:
    return f"(('0x' || sha1('{seed}|' || {key})[1:12])::bigint::double / 281474976710656.0)"


_ORDER = ["sweet_spot", "recoverable_hard", "medium_easy", "low_acc", "unknown", "fallback"]
_QUOTA = {"sweet_spot": 110, "recoverable_hard": 40, "medium_easy": 30, "low_acc": 10, "unknown": 10}
BUCKET_QUOTA = f"""
with p as (select distinct question_id, {RESCUE.format(ok='false')} as bucket from {QUESTIONS}),
o as (select *, sha1('0|' || question_id) as h, row_number() over (partition by bucket order by sha1('0|' || question_id)) as rn from p)
select question_id, bucket from o order by case when rn <= {cases(_QUOTA, 'bucket', 0)} then 0 else 1 end, {cases({b: i for i, b in enumerate(_ORDER)}, 'bucket', 6)}, h limit 200"""

# --- responses -----------------------------------------------------------------------------------------------

STUDENTS = f"(select * replace (len(list_filter(responses, lambda r: r.is_correct)) as num_correct, len(responses) as num_total) from (select *, row_number() over (partition by {KEY_RAW} order by row_idx) as rn from student_responses) where rn = 1)"
GENERATIONS = "(select * from (select *, row_number() over (partition by gen_id order by row_idx) as rn from warmstart_generations) where rn = 1)"
KIND = "case when num_correct = num_total then 'all' when num_correct >= num_total // 2 then 'half' when num_correct > 0 then 'below' else 'zero' end"
GREEDY = f"""
with st as (select row_idx, question, list_transform(list_filter(responses, lambda r: coalesce(r.is_correct, false)), lambda r: r.text) as c, list_transform(list_filter(responses, lambda r: not coalesce(r.is_correct, false)), lambda r: r.text) as w
  from {STUDENTS} where num_correct < num_total and num_correct >= num_total // 2),
ci as (select row_idx, question, unnest(c) as chosen, unnest(range(len(c))) as i from st), ri as (select row_idx, unnest(w) as rejected, unnest(range(len(w))) as j from st),
pairs as (select *, row_number() over (partition by row_idx order by abs(length(chosen) - length(rejected)), i, j) as k from ci join ri using (row_idx)
  where greatest(length(chosen), length(rejected)) / greatest(least(length(chosen), length(rejected)), 1)::double <= 2.5),
one as (select * from pairs where k = 1),
two as (select p.*, row_number() over (partition by p.row_idx order by p.k) as m from pairs p join one using (row_idx) where p.i <> one.i and p.j <> one.j)
select question, chosen, rejected from one union all select question, chosen, rejected from two where m = 1"""

_NUM = "case when regexp_matches({x}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') then try_cast({x} as double) end"


def ratio_number(x: str) -> str:
    c = f"regexp_replace({strip(x)}, '[, ]', '', 'g')"
    a, b = _NUM.format(x=f"split_part({c}, '/', 1)"), _NUM.format(x=f"split_part({c}, '/', 2)")
    return f"(case when contains({c}, '/') then {a} / nullif({b}, 0) else {_NUM.format(x=c)} end)"


BOXES = "regexp_extract_all({t}, '\\\\boxed\\{{([^}}]*)\\}}', 1)"
FLAT = "case when len({b}) > 0 then {s} when regexp_extract({t}, '(?i)(?:the\\s+)?answer\\s+is\\s*[:\\s]*([^\\n\\.]+)', 1) <> '' then {e} end"


def flat_boxed(t: str) -> str:
    b = BOXES.format(t=t)
    return FLAT.format(t=t, b=b, s=strip(f"{b}[-1]"), e=strip(f"regexp_extract({t}, '(?i)(?:the\\s+)?answer\\s+is\\s*[:\\s]*([^\\n\\.]+)', 1)"))


def empty_null(x: str) -> str:
    return f"nullif({x}, '')"


SIMPLE = f"coalesce({empty_null(strip(chr(114) + 'eplace(regexp_extract(full_response, ' + q(chr(92) * 2 + 'boxed' + chr(92) + '{([' + chr(92) + '-' + chr(92) + 'd,' + chr(92) + '.]+)' + chr(92) + '}') + ', 1), ' + q(',') + ', ' + q('') + ')'))}, {empty_null(strip('replace(regexp_extract(full_response, ' + q('####' + chr(92) + 's*([' + chr(92) + '-' + chr(92) + 'd,' + chr(92) + '.]+)') + ', 1), ' + q(',') + ', ' + q('') + ')'))}, regexp_extract_all(full_response, '-?\\d+(?:\\.\\d+)?')[-1])"
FIRST = "coalesce(nullif(regexp_extract(full_response, '\\\\boxed\\{([^}]+)\\}', 1), ''), full_response)"
STATED = f"coalesce(nullif({strip(chr(114) + 'egexp_extract(full_response, ' + q(chr(92) * 2 + 'boxed' + chr(92) + '{([^}]+)' + chr(92) + '}') + ', 1)')}, ''), nullif({strip('regexp_extract(full_response, ' + q('答案(?:是|为)[：:' + SPACE + ']+([^\\n,。]+)') + ', 1)')}, ''), regexp_extract_all(full_response, '-?\\d+(?:\\.\\d+)?|[a-zA-Z]\\^-?\\d+|sqrt\\(\\d+\\)')[-1])"

# --- nested braces -------------------------------------------------------------------------------------------


def closed(rest: str) -> str:
    """What stands before the brace that closes the one opened just before ``rest``; null if none does."""
    at = f"list_filter(range(1, length({rest}) + 1), lambda i: {rest}[i] = '}}' and length(replace({rest}[1:i], '{{', '')) - length(replace({rest}[1:i], '}}', '')) = 1)[1]"
    return f"(case when {at} is not null then {rest}[1 : {at} - 1] end)"


#: A number as the families write it, its value, and how near two values must be.
_REAL = "[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?"


def latex_number(x: str) -> str:
    shown = f"regexp_replace({strip(x)}, '\\\\{{1,2}}(?:text|mathrm|textbf|mathbf)\\{{([^}}]*)\\}}', '\\1', 'g')"
    frac = f"'^(-?)\\\\{{1,2}}d?frac\\{{\\s*({_REAL})\\s*\\}}\\{{\\s*({_REAL})\\s*\\}}$'"
    dense = f"replace(replace({shown}, ',', ''), ' ', '')"
    part = lambda i: f"try_cast(regexp_extract({shown}, {frac}, {i}) as double)"
    quotient = "'^(-?\\d+\\.?\\d*)\\s*/\\s*(\\d+\\.?\\d*)$'"
    return f"""case when regexp_matches({shown}, {frac}) and {part(3)} <> 0 then {part(2)} / {part(3)} * case when regexp_extract({shown}, {frac}, 1) = '-' then -1 else 1 end
      when regexp_matches({dense}, '^\\s*{_REAL}\\s*$') then try_cast(trim({dense}) as double)
      when regexp_matches({dense}, {quotient}) then try_cast(regexp_extract({dense}, {quotient}, 1) as double) / nullif(try_cast(regexp_extract({dense}, {quotient}, 2) as double), 0) end"""


def near(p: str, g: str, tol: str, zero_first: bool) -> str:
    whole = f"{g} = floor({g}) and abs({g}) < 1e9" + (f" and abs({g}) >= 1e-10" if zero_first else "")
    return f"coalesce(abs({p} - {g}) < case when {whole} then 0.5 else {tol} * greatest(abs({g}), 1.0) end, false)"


def nested(source: str, key: str, zero_first: bool) -> str:
    """The last box that closes, by where it opens, and whether its value is the reference's; ``source`` has key, t and gt."""
    return f"""
with o as (select {key}, t, gt, list_filter(range(1, length(t) + 1), lambda i: t[i] = chr(92) and regexp_matches(t[i : i + 12], '^\\\\{{1,2}}boxed\\s*\\{{')) as spots from ({source})),
u as (select {key}, gt, i, regexp_replace(t[i :], '^\\\\{{1,2}}boxed\\s*\\{{', '') as rest from (select {key}, t, gt, unnest(spots) as i from o)),
b as (select {key}, arg_max(content, i) as pred from (select {key}, i, {closed('rest')} as content from u) where content is not null group by 1)
select o.{key}, b.pred, {near('(' + latex_number('b.pred') + ')', '(' + latex_number('o.gt') + ')', '0.001', zero_first)} as correct from o left join b using ({key})"""


_GEN = f"select gen_id, case when ground_truth is not null then full_response end as t, ground_truth as gt from {GENERATIONS}"
_RESP = f"select row_idx * 1000 + j as rid, row_idx, r.text as t, ground_truth as gt, r.is_correct as is_correct from (select row_idx, ground_truth, unnest(responses) as r, unnest(range(len(responses))) as j from {STUDENTS})"
RESCORED = f"""
select row_idx, count_if(correct) as num_correct, count(*) as num_total, count_if(is_correct) as stored from ({nested(_RESP, 'rid', True)}) join ({_RESP}) using (rid) group by row_idx"""


def few_shot_form(x: str) -> str:
    return f"rtrim(replace(replace(replace(regexp_replace({strip(x)}, '\\\\(?:text|mathrm|textbf)\\{{([^}}]*)\\}}', '\\1', 'g'), '$', ''), ' ', ''), '\\dfrac', '\\frac'), '.')"


_PLAIN = lambda x: f"(case when regexp_matches(replace({x}, ',', ''), '^\\s*{_REAL}\\s*$') then try_cast(trim(replace({x}, ',', '')) as double) end)"
FEW_SHOT = f"""
with r as (select gen_id, gt, case when contains(t, '\\boxed{{') then t[length(t) - strpos(reverse(t), reverse('\\boxed{{')) + 2 :] end as rest from ({_GEN})),
p as (select gen_id, gt, {strip(closed('rest'))} as pred from r),
f as (select gen_id, pred, {few_shot_form('pred')} as a, {few_shot_form('gt')} as b from p),
v as (select *, {_PLAIN('a')} as x, {_PLAIN('b')} as y from f)
select gen_id, pred, coalesce(a = b or abs(x - y) < 1e-6 or (y <> 0 and abs(x - y) / abs(y) < 1e-4), false) as correct from v"""

def last_box(t: str) -> str:
    """The content of the box that opens last, null if it does not close."""
    rest = f"{t}[length({t}) - strpos(reverse({t}), reverse('\\boxed{{')) + 2 :]"
    return f"(case when contains({t}, '\\boxed{{') then {closed(rest)} end)"


def before_notes(t: str, marks: tuple[str, ...]) -> str:
    for m in marks:
        t = f"split_part({t}, {q(m)}, 1)"
    return t


def first_of(t: str, *phrases: str) -> str:
    """When-branches: what the first phrase that matches holds, without commas."""
    return " ".join(f"when regexp_matches({t}, {q(p)}) then {strip(f'replace(regexp_extract({t}, {q(p)}, 1), {q(chr(44))}, {q(str())})')}" for p in phrases)


def found_last(t: str, phrase: str, group: int) -> str:
    return f"regexp_extract_all({t}, {q(phrase)}, {group})[-1]"


_REALS = "[-0-9,.]+"
_WS = f"[{SPACE}]"


def last_digits(x: str) -> str:
    bare = strip(f"replace(replace({strip(x)}, ',', ''), '$', '')")
    return f"coalesce(replace(regexp_extract_all({bare}, '-?[0-9][0-9,]*\\.?[0-9]*')[-1], ',', ''), {bare})"


def exam_text(x: str) -> str:
    """The exam family's form, before numbers are read."""
    x = f"replace(replace(regexp_replace({strip(x)}, '[$%]|\\\\left|\\\\right', '', 'g'), '\\dfrac', '\\frac'), '\\tfrac', '\\frac')"
    x = f"rtrim({strip(f'regexp_replace({x}, {q(chr(92) * 2 + "[!,;:]")}, {q(str())}, {q("g")})')}, '.;')"
    x = f"regexp_replace({x}, '^{_WS}*[a-zA-Z]{_WS}*\\\\in{_WS}*', '')"
    x = f"regexp_replace(regexp_replace({x}, '{_WS}*,{_WS}*', ',', 'g'), '{_WS}*\\\\cup{_WS}*', '\\\\cup', 'g')"
    x = strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")
    return f"(case when regexp_matches({x}, '^[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?$') then replace({x}, ',', '') else {x} end)"


def exam_value(x: str) -> str:
    slash, frac = "'^([-+]?)\\s*([0-9]+)\\s*/\\s*([0-9]+)$'", "'^([-+]?)\\\\frac\\{(-?[0-9]+)\\}\\{(-?[0-9]+)\\}$'"
    of = lambda p: f"when regexp_matches({x}, {p}) then try_cast(regexp_extract({x}, {p}, 2) as double) / nullif(try_cast(regexp_extract({x}, {p}, 3) as double), 0) * case when regexp_extract({x}, {p}, 1) = '-' then -1 else 1 end"
    return f"case when regexp_matches({x}, '^\\s*{_REAL}\\s*$') then try_cast(trim({x}) as double) {of(slash)} {of(frac)} end"


def judged_exam(extract: str) -> str:
    """Verdicts of the exam family for answers read by ``extract`` from t, the text before its notes, and whole."""
    return f"""
with r as (select gen_id, gt, whole, t from (select gen_id, ground_truth as gt, full_response as whole, {before_notes('full_response', NOTES)} as t from {GENERATIONS})),
p as (select gen_id, gt, case when gt is not null and whole is not null then {extract} end as pred from r),
f as (select gen_id, pred, {exam_text('pred')} as a, {exam_text('gt')} as b from p),
v as (select *, {exam_value('a')} as x, {exam_value('b')} as y, lower(regexp_replace(a, '{_WS}+', '', 'g')) as c, lower(regexp_replace(b, '{_WS}+', '', 'g')) as d from f)
select gen_id, pred, coalesce(case when x is not null and y is not null then abs(x - y) < 1e-6 when x is null and y is null then c = d else false end, false) as correct from v"""


EXAM = judged_exam(
    f"case when {last_box('t')} is not null then {strip(last_box('t'))} "
    + " ".join(f"when regexp_matches(t, {q(p)}) then {strip(f'regexp_extract(t, {q(p)}, 1)')}" for p in (f"(?i)answer is{_WS}*\\$?(.*?)\\$?{_WS}*[.\\n]", f"(?i)answer:{_WS}*\\$?(.*?)\\$?{_WS}*[.\\n]"))
    + " else '' end"
)
WORD_PROBLEM = judged_exam(
    f"case when {last_box('t')} is not null then {last_digits(last_box('t'))} {first_of('t', f'####{_WS}*({_REALS})', f'(?i)answer is{_WS}*[$]?({_REALS})', f'(?i)answer:{_WS}*[$]?({_REALS})')} "
    f"else coalesce({strip(f'replace({found_last(chr(116), "[*][*][$]?(" + _REALS + ")[$]?[*][*]", 1)}, {q(chr(44))}, {q(str())})')}, {strip(f'replace({found_last(chr(116), _REALS, 0)}, {q(chr(44))}, {q(str())})')}, '') end"
)


def final_form(x: str) -> str:
    """The reward family's form, step by step."""
    x = f"regexp_replace({x}, '(?s)^.*=', '')"
    for old, new in [("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\left", ""), ("\\right", ""), *answers.REWRITES, *((u, "") for u in answers.REMOVED)]:
        x = f"replace({x}, {q(old)}, {q(new)})"
    for pattern, new in [*((f"\\\\{c}\\{{(.*?)\\}}", "\\1") for c in ("text", "textbf", "overline")), ("\\\\boxed\\{(.*)\\}", "\\1"), ("frac([^{])(.)", "frac{\\1}{\\2}"), ("sqrt([^{])", "sqrt{\\1}")]:
        x = f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"
    return f"replace({x}, '$', '')"


def final_value(x: str) -> str:
    of = lambda p: f"when regexp_matches({x}, {p}) then try_cast(regexp_extract({x}, {p}, 2) as double) / nullif(try_cast(regexp_extract({x}, {p}, 3) as double), 0) * case when regexp_extract({x}, {p}, 1) = '-' then -1 else 1 end"
    first, second = "'^(-?)([0-9]+)/([0-9]+)$'", "'^(-?)\\\\frac\\{(-?[0-9]+)\\}\\{(-?[0-9]+)\\}$'"
    return f"case when regexp_matches({x}, '^-?[0-9]+(?:\\.[0-9]+)?$') then try_cast({x} as double) {of(first)} {of(second)} end"


_GROUPED = lambda x: strip(f"case when regexp_matches({x}, '^,*[0-9][0-9,]*$') then replace({x}, ',', '') else {x} end")
_SAID = "regexp_extract_all(full_response, '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1]"
FINAL = f"""
with r as (select gen_id, ground_truth, full_response, {last_box('full_response[greatest(1, length(full_response) - 299) :]')} as box from {GENERATIONS}),
s as (select gen_id, box is not null as has_boxed, full_response is null or ground_truth is null as none, {final_form(f'coalesce(box, {_SAID})')} as p, {final_form('ground_truth')} as g from r),
f as (select gen_id, has_boxed and not none as has_boxed, case when none then '[INVALID]' else coalesce({_GROUPED('p')}, '[INVALID]') end as pred, none, {_GROUPED('g')} as want from s),
v as (select *, {final_value('pred')} as a, {final_value('want')} as b from f),
j as (select *, not none and (pred = want or coalesce(abs(a - b) <= 1e-8, false)) as acc from v)
select gen_id, pred, acc, not none and not acc and coalesce(abs(a - b) <= 1e-4 or abs(a - b) / greatest(abs(b), 1.0) <= 0.01, false) as near_correct, has_boxed from j"""

def tidy(x: str) -> str:
    """A decimal without rounding noise and trailing zeros."""
    v = f"(case when regexp_matches({x}, '^\\s*{_REAL}\\s*$') then try_cast(trim({x}) as double) end)"
    return f"(case when {v} is null then {x} when abs({v} - round({v})) < 1e-4 then cast(cast(round({v}) as hugeint) as varchar) when contains({x}, '.') then rtrim(rtrim({x}, '0'), '.') else {x} end)"


def bare_decimal(x: str) -> str:
    bare = f"rtrim({strip(x)}, '.')"
    return f"(case when contains({bare}, '.') then rtrim(rtrim({bare}, '0'), '.') else {bare} end)"


_FIGURES = "-?[0-9][0-9,]*\\.?[0-9]*"
_WORD_NOTES = ("*Note:", "*note:", "(Note:", "Note: The", "**Note", "*Verification", "*Context:", "*Correction")
_BOLD, _EQUALS = f"[*][*][$]?({_REALS})[$]?[*][*]", f"={_WS}*[$]?({_REALS})"
_CLOSING = f"(?i)(?:answer|total|result|profit|cost|makes?|spend|earns?){_WS}+(?:is|are|was|=|:){_WS}+[$]?({_REALS})"
FEW_SHOT_WORD = f"""
with r as (select gen_id, ground_truth as gt, full_response as t, {before_notes('full_response', _WORD_NOTES)} as n from {GENERATIONS}),
b as (select *, {last_box('t')} as box, replace({found_last('n', _BOLD, 1)}, ',', '') as bold, replace({found_last('n', _EQUALS, 1)}, ',', '') as equal,
  list_filter(list_transform(regexp_extract_all(n, '{_FIGURES}'), lambda x: replace(x, ',', '')), lambda x: length(x) <= 15)[-1] as figure from r),
c as (select *, replace(replace(box, ',', ''), '$', '') as said from b),
p as (select gen_id, gt, case when t is null or gt is null then null
  when box is not null then case when regexp_matches(said, '{_FIGURES}') then {tidy(f"replace(regexp_extract_all(said, '{_FIGURES}')[-1], ',', '')")} else {strip(f"replace(replace({strip('box')}, ',', ''), '$', '')")} end
  when regexp_matches(t, '####{_WS}*({_REALS})') then {tidy(strip(f"replace(regexp_extract(t, '####{_WS}*({_REALS})', 1), ',', '')"))}
  when length(bold) <= 15 then {tidy('bold')} when length(equal) <= 15 then {tidy('equal')}
  when regexp_matches(n, {q(_CLOSING)}) then {tidy(f"replace(regexp_extract(n, {q(_CLOSING)}, 1), ',', '')")} when figure is not null then {tidy('figure')} end as pred from c)
select gen_id, pred, coalesce({bare_decimal('pred')} = {bare_decimal('gt')}, false) as correct from p"""
_TAIL_ZH, _TAIL_EN = f"(?m)答案[为是]{_WS}*[：:{SPACE}]*(.+?)$", f"(?im)(?:the{_WS}+)?answer{_WS}+is{_WS}*[：:{SPACE}]*(.+?)\\.?{_WS}*$"
REFERENCE_SOURCES = f"""
with a as (select answer, {BOXES.format(t='answer')} as boxes, regexp_extract(answer, {q(_TAIL_ZH)}, 1) as zh, regexp_extract(answer, {q(_TAIL_EN)}, 1) as en, {strip("regexp_extract_all(answer[greatest(1, length(answer) - 199) :], '[*][*]([^*]+)[*][*]', 1)[-1]")} as bold from dpo_questions_24k_v2),
g as (select case when len(list_filter(boxes, lambda x: x <> '')) > 0 then {{'s': 'boxed', 'g': {strip("list_filter(boxes, lambda x: x <> '')[-1]")}}} when zh <> '' then {{'s': 'answer_tail_zh', 'g': zh}} when en <> '' then {{'s': 'answer_tail_en', 'g': en}}
  when length(bold) < 80 and not regexp_matches(bold, '^(?:Question|Answer|Code)') then {{'s': 'answer_bold', 'g': bold}} else {{'s': 'none', 'g': null}} end as x from a)
select x.s as gt_source, count(*) as n, count(x.g) as found from g group by 1"""

# --- learning progress ---------------------------------------------------------------------------------------

RATES = "select sample_id, coalesce(is_pg, false) as is_pg, step, avg(case when reward > 0 then 1.0 else 0.0 end) as rate from lp_observations where sample_id is not null and step is not null group by all"
STATES = f"""
with r as ({RATES}), o as (select *, row_number() over w - 1 as k, count(*) over (partition by sample_id, is_pg) as n from r window w as (partition by sample_id, is_pg order by step)),
e as (select sample_id, is_pg, max(n) as n, sum(case when k = 0 then pow(0.8, n - 1) else 0.2 * pow(0.8, n - 1 - k) end * rate) as p, max(case when k = n - 1 then rate end) as last from o group by all)
select coalesce(a.sample_id, b.sample_id) as sample_id, coalesce(a.p, 0) as p, case when a.n > 1 then a.p - (a.p - 0.2 * a.last) / 0.8 else 0 end as lp, coalesce(a.n, 0) as n_updates, b.p as pg_p_ema, b.n as pg_seen
from (select * from e where not is_pg) a full join (select * from e where is_pg) b using (sample_id)"""
WEIGHT = "coalesce(1 / (1 + exp(-8.0 * lp)) + 0.5, 1.0)"
SAMPLE_ID = f"sha1({strip('question')} || '||' || {strip('ground_truth')})[1:16]"
LABELS = "list_filter([case when p < 0.05 then 'hard_zero' when p < 0.15 then 'struggling' when p > 0.8 then 'mastered' when p <= 0.5 then 'sweet_spot' end, case when p between 0.15 and 0.8 and lp > 0 then 'learning' end], lambda x: x is not null)"

# --- tokens --------------------------------------------------------------------------------------------------

LOGITS = "select vec_id, list_transform(embedding, lambda x: x::double) as s, list_reverse(list_transform(embedding, lambda x: x::double)) as t from embeddings"


def log_softmax(a: str) -> str:
    return f"list_transform({a}, lambda x: x - list_max({a}) - ln(list_sum(list_transform({a}, lambda y: exp(y - list_max({a}))))))"


LOGS = f"select vec_id, {log_softmax('s')} as s, {log_softmax('t')} as t from ({LOGITS})"


def kl(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: exp({a}[i]) * ({a}[i] - {b}[i])))"



def shuffled(x: str) -> str:
    """A list in the order of the hashes of its numbered items."""
    return f"list_transform(list_sort(list_transform(range(len({x})), lambda i: {{'h': sha1('0' || i || {x}[i + 1]), 'x': {x}[i + 1]}})), lambda e: e.x)"


SIMPLE_PAIRS = f"""
with st as (select question, list_transform(list_filter(responses, lambda r: coalesce(r.is_correct, false)), lambda r: r.text) as c, list_transform(list_filter(responses, lambda r: not coalesce(r.is_correct, false)), lambda r: r.text) as w
  from {STUDENTS} where num_correct < num_total and num_correct > 0),
o as (select question, {shuffled('c')} as c, {shuffled('w')} as w, case when len(c) >= 2 and len(w) >= 2 then 2 else least(1, len(c), len(w)) end as n from st)
select question, unnest(c[1:n]) as chosen, unnest(w[1:n]) as rejected from o"""
THINK = f"select gen_id, case when gen_id % 2 = 0 then '<think>' else '' end || prefix || '</think>' || coalesce(continuation, '') as t from {GENERATIONS}"
AFTER = "regexp_extract(t, '(?s)</think>(.*)', 1)"
BARE = strip("regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')")
THINKING = f"""
select gen_id, case when {BARE} <> '' then {BARE} when {strip(AFTER)} <> '' then {strip(AFTER)} else t end as bare,
  case when not contains(split_part(t, '</think>', 1), '<think>') then '<think>' || chr(10) || regexp_replace(t, '^[{SPACE}]+', '') else t end as marked, {flat_boxed(AFTER)} as pred from ({THINK})"""


def js(s: str, t: str) -> str:
    m = f"ln(greatest(0.5 * (exp({s}[i]) + exp({t}[i])), 1e-8))"
    return f"greatest(0.0, list_sum(list_transform(range(1, len({s}) + 1), lambda i: 0.5 * exp({s}[i]) * ({s}[i] - {m}) + 0.5 * exp({t}[i]) * ({t}[i] - {m}))))"


_TOP = "list_sort(list_transform(range(1, len(t) + 1), lambda i: {'o': -t[i], 't': t[i], 's': s[i]}))[1:4]"
TOKEN_WEIGHTS = f"""
with l as ({LOGITS}), k as (select vec_id, s, t, list_transform({_TOP}, lambda e: e.s) as s4, list_transform({_TOP}, lambda e: e.t) as t4 from l),
g as (select vec_id, {log_softmax('s')} as s, {log_softmax('t')} as t, {log_softmax('s4')} as s4, {log_softmax('t4')} as t4 from k),
v as (select vec_id, -list_sum(list_transform(s, lambda x: exp(x) * x)) / ln(len(s)) as ent, {js('s', 't')} / ln(2) as div, {js('s4', 't4')} / ln(2) as div4 from g)
select vec_id, round(ent, 6) as ent, round(div, 6) as div, round(div4, 6) as div4, round(greatest(ent, 1e-8) * sqrt(greatest(div, 1e-8)), 6) as weight from v"""

def obj(**fields: str) -> str:
    """A JSON object of expressions, in order, without those that are null."""
    return "json_object(" + ", ".join(f"{q(k)}, {v}" for k, v in fields.items()) + ")"


def said(*parts: tuple[str, str], keys: tuple[str, str] = ("role", "content")) -> str:
    """A JSON array of messages."""
    return "json_array(" + ", ".join(obj(**{keys[0]: q(who), keys[1]: text}) for who, text in parts) + ")::varchar"


def sparse(**fields: str) -> str:
    """A JSON object without its null fields."""
    return f"json_merge_patch('{{}}', {obj(**fields)})::varchar"


_CYCLE_SHARES = {"sweet_spot": 90, "learning": 50, "struggling": 20, "mastered": 10, "exploration": 10}
CYCLE = f"""
with ids as (select distinct {SAMPLE_ID} as sample_id from dpo_questions_24k_v2 where question is not null and ground_truth is not null), s as ({STATES}), c as (select sample_id, unnest({LABELS}) as category from s),
pool as (select sample_id, category from ids join c using (sample_id) union all select sample_id, 'exploration' from ids where sample_id not in (select sample_id from s)),
o as (select *, row_number() over (partition by category order by sha1('0|' || sample_id || '|' || category)) as k from pool),
picked as (select sample_id, category from o where k <= {cases(_CYCLE_SHARES, 'category', 0)}),
more as (select sample_id, category, row_number() over (order by sha1('0+|' || sample_id || '|' || category)) as k from pool where category in ('sweet_spot', 'learning'))
select * from picked union all select sample_id, category from more where k <= 200 - (select count(*) from picked)"""
_TURN = ("from", "value")
STATED_ANSWER = STATED.replace("full_response", "answer")
WITH_BOX = f"case when contains(answer, '\\boxed{{') or {STATED_ANSWER} is null then answer else answer || chr(10) || chr(10) || '答案为 $\\boxed{{' || {STATED_ANSWER} || '}}$' end"
EARLY = f"""
with r as (select *, row_number() over (partition by sample_id order by step) as k from ({RATES}) where not is_pg),
f as (select sample_id, max(case when k = 1 then rate end) as a, max(case when k = 2 then rate end) as b from r where k <= 2 group by 1)
select sample_id, 2 as n_updates from f where b is not null and 0.8 * a + 0.2 * b <= 0.05 and 0.2 * (b - a) <= 0.01"""
INITIAL = f"select sample_id, arg_max(num_correct / greatest(num_total, 1)::double, row_idx) as p0 from (select *, {SAMPLE_ID} as sample_id from student_responses) group by 1"
CONTINUED = f"""
with r as (select sample_id, step, rate from ({RATES}) where not is_pg), i as ({INITIAL}),
o as (select *, row_number() over w - 1 as k, count(*) over (partition by sample_id) as n from r window w as (partition by sample_id order by step)),
e as (select sample_id, max(n) as n, sum(case when p0 is null and k = 0 then pow(0.8, n - 1) else 0.2 * pow(0.8, n - 1 - k) end * rate) + coalesce(max(p0) * pow(0.8, max(n)), 0) as p, max(p0) as p0 from o left join i using (sample_id) group by sample_id),
g as (select distinct sample_id from ({RATES}) where is_pg)
select coalesce(e.sample_id, i.sample_id, g.sample_id) as sample_id, round(coalesce(e.p, i.p0, 0), 6) as p, (coalesce(e.n, 0) + case when i.p0 is null then 0 else 1 end)::int as n_updates
from e full join i using (sample_id) full join g using (sample_id)"""
MIXED = f"""
with a as (select question, ground_truth, chosen, rejected, 'on_policy' as source from ({GREEDY.replace('select row_idx, question, list_transform', 'select row_idx, question, ground_truth, list_transform', 1).replace('ci as (select row_idx, question, unnest', 'ci as (select row_idx, question, ground_truth, unnest').replace('select question, chosen, rejected', 'select question, ground_truth, chosen, rejected')})),
t as (select {KEY_RAW} as qkey, arg_max(full_response, row_idx) as teacher_response from warmstart_generations where is_correct group by 1),
w as (select question, ground_truth, {KEY_RAW} as qkey, list_transform(list_filter(responses, lambda r: not coalesce(r.is_correct, false)), lambda r: r.text) as w from {STUDENTS} where num_correct < num_total // 2),
b as (select question, ground_truth, teacher_response as chosen, {shuffled('w')}[1] as rejected, 'teacher' as source from w join t using (qkey)),
c as (select * from b where length(chosen) > 0 and length(rejected) > 0 and greatest(length(chosen), length(rejected)) / least(length(chosen), length(rejected))::double <= 2.5)
select question, ground_truth, chosen, rejected, source from (select *, 0 as p from a union all select *, 1 from c) order by p, sha1('0|' || chosen) limit 100"""
_LETTERS = "list_transform(string_split(regexp_replace(lower({x}), '[^a-z]', '', 'g'), ''), lambda c: ascii(c))"


def sequence(prompt: str, response: str, loss: str, length: int, zero: str = "0") -> dict[str, str]:
    """The four arrays of a padded sequence as JSON; ``loss`` gives the i-th trained flag, from 0."""
    r = f"{response}[1 : {length - 1}]"
    p = f"{prompt}[greatest(1, len({prompt}) - ({length} - len({r})) + 1) :]"
    n = f"(len({p}) + len({r}))"
    zeros = f"list_transform(range({length} - {n}), lambda i: 0)"
    text = lambda x: f"to_json({x})::varchar"
    return {
        "input_ids": text(f"list_concat({p}, {r}, {zeros})"), "attention_mask": text(f"list_concat(list_transform(range({n}), lambda i: 1), {zeros})"), "position_ids": text(f"list_concat(range({n}), {zeros})"),
        "loss_mask": text(f"list_concat(list_transform(range(len({p})), lambda i: {zero}), list_transform(range(len({r})), lambda i: {loss}), list_transform(range({length} - {n}), lambda i: {zero}))"),
    }


_PAIRED = {f"{who}_{k}": v for who, prompt in (("student", "p"), ("teacher", "t")) for k, v in sequence(prompt, "r", "(i % 3 <> 2)::int", 512).items()}
TOKEN_SAMPLES = f"""
with w as ({TOKEN_WEIGHTS.replace("select vec_id, round(ent, 6) as ent, round(div, 6) as div, round(div4, 6) as div4, round(greatest(ent, 1e-8) * sqrt(greatest(div, 1e-8)), 6) as weight from v", "select vec_id, greatest(ent, 1e-8) * sqrt(greatest(div, 1e-8)) as weight from v")}),
o as (select vec_id // 32 as sequence, vec_id, weight, row_number() over (partition by vec_id // 32 order by vec_id) - 1 as token, count(*) over (partition by vec_id // 32) as n_total from w),
d as (select *, row_number() over (partition by sequence order by -ln(greatest({uniform('0', "sequence || '|' || token")}, pow(2.0, -49))) / greatest(weight, 1e-300)) as k from o)
select sequence, n_total, token, vec_id from d where k <= greatest(1, floor(n_total * 0.5))"""

ORACLES: dict[str, str] = {
    "answers_nested": nested(_GEN, "gen_id", True),
    "answers_nested_whole_first": nested(_GEN, "gen_id", False),
    "answers_few_shot": FEW_SHOT,
    "answers_few_shot_word": FEW_SHOT_WORD,
    "reference_sources": REFERENCE_SOURCES,
    "training_rows": f"select 'math' as data_source, 'math' as ability, {said(('system', q(preference.SYSTEM)), ('user', 'question'))} as prompt, {sparse(style=q('rule'), ground_truth='ground_truth')} as reward_model, {sparse(sample_id=SAMPLE_ID, category='category', student_accuracy='acc', is_pg_sample='false', index='row_idx')} as extra_info from {QUESTIONS}",
    "lp_cycle": CYCLE,
    "answers_exam": EXAM,
    "answers_word_problem": WORD_PROBLEM,
    "answers_final": FINAL,
    "rescored": RESCORED,
    "batch_numbers": "select row_idx, (row_number() over (order by row_idx) - 1) // 64 as batch from dpo_questions_24k_v2",
    "parquet_row_ids": "select 'eval_items_' || (row_number() over () - 1) as id, item_id from eval_items",
    "shuffled_rows": "select row_idx, row_number() over (order by sha1('42|' || row_idx)) - 1 as position from dpo_questions_24k_v2",
    "ratio_split": "select question_id, case when rn <= floor(n * 0.8) then 'train' else 'val' end as split from (select question_id, row_number() over (order by sha1('0|' || question_id)) as rn, count(*) over () as n from (select distinct question_id from dpo_questions_24k_v2))",
    "chat_few_shot_prompts": f"select item_id, {q('<|im_start|>system' + chr(10) + preference.SYSTEM + '<|im_end|>' + chr(10))} || (select string_agg('<|im_start|>user' || chr(10) || {strip('problem')} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || regexp_replace({strip('solution')}, '<<[^>]+>>', '', 'g') || '<|im_end|>' || chr(10), '' order by item_id) from (select * from eval_items order by item_id limit 8)) || '<|im_start|>user' || chr(10) || {strip('problem')} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt from eval_items",
    "teacher_messages": f"select row_idx, {said(('system', q(preference.SYSTEM)), ('user', 'question || chr(10) || chr(10) || ' + q('The correct answer is ') + ' || ground_truth || ' + q('.')))} as messages from dpo_questions_24k_v2",
    "warm_start_format": f"select {said(('human', 'question'), ('gpt', 'full_response'), keys=_TURN)} as conversations, {q(preference.SYSTEM)} as system from {GENERATIONS}",
    "conversations": f"select row_idx, {said(('human', 'question'), ('gpt', WITH_BOX), keys=_TURN)} as conversations from dpo_questions_24k_v2",
    "preference_format": f"select {said(('human', strip('question')), keys=_TURN)} as conversations, {obj(**{'from': q('gpt'), 'value': 'chosen'})}::varchar as chosen, {obj(**{'from': q('gpt'), 'value': 'rejected'})}::varchar as rejected, {q(preference.SYSTEM)} as system from ({GREEDY})",
    "mixed_pairs": MIXED,
    "lp_guided_early": EARLY,
    "lp_guided_students": f"""
with e as (select {SAMPLE_ID} as sample_id, unnest(responses) as r, unnest(range(len(responses))) as i from {STUDENTS}),
r as (select sample_id, avg(case when coalesce(r.is_correct, false) then 1.0 else 0.0 end) filter (i < 4) as a, avg(case when coalesce(r.is_correct, false) then 1.0 else 0.0 end) filter (i >= 4) as b from e group by 1)
select sample_id, 2 as n_updates from r where b is not null and 0.8 * a + 0.2 * b <= 0.05 and 0.2 * (b - a) <= 0.01""",
    "lp_continued": CONTINUED,
    "lp_snapshot": f"select 0.8::double as beta, 8.0::double as kappa, 0.5::double as b, round(avg(p), 6) as avg_p, round(avg({WEIGHT}), 6) as avg_weight, count(*) as n, count(*) as loaded from ({STATES})",
    "padded_sequences": "select item_id, " + ", ".join(f"{v} as {k}" for k, v in sequence("p", "r", "1.0::double", 16384, "0.0::double").items()) + f" from (select item_id, {_LETTERS.format(x='problem')} as p, {_LETTERS.format(x='solution')} as r from eval_items)",
    "paired_sequences": "select item_id, type, true as valid_row_mask, " + ", ".join(f"{v} as {k}" for k, v in _PAIRED.items()) + f" from (select item_id, type, {_LETTERS.format(x='problem')} as p, {_LETTERS.format(x='concat_ws(chr(32), problem, level)')} as t, {_LETTERS.format(x='solution')} as r from eval_items)",
    "token_samples": TOKEN_SAMPLES,
    "doc_features": features("sample_input", "row_idx"),
    "doc_scores": SCORES,
    "route_histogram": f"select route, count(*) as n, round(avg(score), 6) as avg_score from ({SCORES}) group by route",
    "adjacent_line_dedup": f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
p as (select *, {strip('line')} as s, lag({strip('line')}) over (partition by doc_id order by i) as before from l)
select doc_id, string_agg(line, chr(10) order by i) as text from p where i = 1 or s = '' or s <> before group by doc_id""",
    "recall_checks": f"""
select gen_id, round(case when len(a) = 0 then 1.0 else len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a))::double end, 6) as numbers,
  round(case when {count('full_response', X.SYMBOL)} = 0 then 1.0 else least({count('continuation', X.SYMBOL)} / {count('full_response', X.SYMBOL)}::double, 1.5) end, 6) as symbols,
  {' and '.join(f"abs({count('continuation', chr(92) + x)} - {count('continuation', chr(92) + y)}) <= abs({count('full_response', chr(92) + x)} - {count('full_response', chr(92) + y)}) + 2" for x, y in ('()', '[]', '{}'))} as brackets,
  not ({count('full_response', chr(92) + '$')} % 2 = 0 and {count('continuation', chr(92) + '$')} % 2 <> 0) and abs({count('continuation', 'begin{'.join([chr(92) * 2, '']).replace('{', chr(92) + '{'))} - {count('continuation', 'end{'.join([chr(92) * 2, '']).replace('{', chr(92) + '{'))}) <= abs({count('full_response', 'begin{'.join([chr(92) * 2, '']).replace('{', chr(92) + '{'))} - {count('full_response', 'end{'.join([chr(92) * 2, '']).replace('{', chr(92) + '{'))}) + 1 as latex
from (select *, regexp_extract_all(full_response, {q(X.NUMBER)}) as a, regexp_extract_all(continuation, {q(X.NUMBER)}) as b from {GENERATIONS}) where continuation is not null""",
    "resume_antijoin": "select doc_id as id, lang from documents where int_score is null or int_score < 3",
    "corpus_prefilter": f"select doc_id, int_score, token_count from documents where coalesce(token_count, 0) between 50 and 8192 and coalesce(int_score, 0) >= 3 and regexp_matches(text, '[^{SPACE}]')",
    "prefix_dedup": f"select row_idx, qkey from (select row_idx, {KEY_STRIP} as qkey, row_number() over (partition by {KEY_STRIP} order by row_idx) as rn from dpo_questions_24k_v2) where rn = 1",
    "last_wins": f"select qkey, max(row_idx) as row_idx, arg_max(ground_truth, row_idx) as ground_truth from (select {KEY_RAW} as qkey, row_idx, ground_truth from dpo_questions_24k_v2) group by qkey",
    "subject_histogram": f"select {LONG} as subject, {SHORT} as short, count(*) as n from dpo_questions_24k_v2 group by all",
    "reject_cascade": cascade(f"coalesce(nullif(category, ''), {LONG})", selection.EXCLUDED, False),
    "reject_cascade_training": cascade(SHORT, selection.EXCLUDED_SHORT, True),
    "next_round_pool": f"select row_idx, {KEY_RAW} as qkey from dpo_questions_24k_v2 where {VALID} and length(answer) between 200 and 800 and length(question) between 50 and 1500 and {SHORT} not in ({', '.join(map(q, selection.EXCLUDED_SHORT))}) and {KEY_RAW} not in (select {KEY_RAW} from student_responses where question is not null)",
    "sample_ids": f"select row_idx, {SAMPLE_ID} as sample_id from dpo_questions_24k_v2",
    "reference_kinds": f"select kind, big, valid, count(*) as n from (select case when regexp_matches(g, '^-?\\d+$') then 'integer' when regexp_matches(g, '^-?\\d+\\.\\d+$') then 'decimal' when regexp_matches(g, '^-?\\d+/\\d+$') then 'fraction' else 'other' end as kind, coalesce(abs({_NUM.format(x='g')}) > 10000, false) as big, {VALID} as valid from (select *, {strip('ground_truth')} as g from dpo_questions_24k_v2)) group by all",
    "length_tiers": f"select case when n >= 200 and n < 600 then 'short' when n >= 600 and n < 1200 then 'mid' when n >= 1200 and n < 2000 then 'long' else 'none' end as tier, bin, count(*) as n from (select length(answer) as n, {BIN} as bin from {QUESTIONS}) group by 1, 2",
    "difficulty_buckets": f"select {PLAIN} as plain, {RESCUE.format(ok='row_idx % 3 = 0')} as rescue, {START} as start, count(*) as n from {QUESTIONS} group by 1, 2, 3",
    "quota_top": "select doc_id, lang from (select doc_id, coalesce(lang, 'none') as lang, row_number() over (partition by coalesce(lang, 'none') order by sha1('0|' || doc_id)) as rn from documents) where rn <= case when lang = 'en' then 100 else 25 end",
    "bucket_quota": BUCKET_QUOTA,
    "balanced_classes": f"""
with p as (select question_id, any_value({classify(selection.SUBJECTS_SHORT, {})}) as subject from dpo_questions_24k_v2 group by question_id), n as (select greatest(1, count(*) // count(distinct subject)) as quota from p)
select question_id, subject from (select *, row_number() over (partition by subject order by sha1('0|' || question_id)) as rn from p), n where rn <= quota""",
    "train_test_split": "select question_id, case when rn <= n - 80 then 'train' else 'test' end as split from (select question_id, row_number() over (order by sha1('0|' || question_id)) as rn, count(*) over () as n from (select distinct question_id from dpo_questions_24k_v2))",
    "shard_slices": "select row_idx, (ntile(7) over (order by row_idx) - 1)::int as shard from dpo_questions_24k_v2",
    "hash_shuffle": "select row_idx from dpo_questions_24k_v2 order by sha1('42|' || row_idx) limit 50",
    "bernoulli_sample": f"select doc_id from documents where {uniform('7', 'doc_id')} <= 0.3",
    "tier_choice": f"select doc_id, level, round(lo + (hi - lo) * v, 6) as ratio from (select doc_id, level, v, {cases({'short': 0.15, 'mid': 0.25, 'long': 0.4}, 'level', 0)}::double as lo, {cases({'short': 0.25, 'mid': 0.4, 'long': 0.55}, 'level', 0)}::double as hi from (select doc_id, case when {uniform('tier', 'doc_id')} < 0.5 then 'short' when {uniform('tier', 'doc_id')} < 0.85 then 'mid' else 'long' end as level, {uniform('ratio', 'doc_id')} as v from documents))",
    "left_join_accuracy": f"""
with a as (select {KEY_STRIP} as qkey, arg_max(num_correct / greatest(num_total, 1)::double, row_idx) as acc from student_responses group by 1)
select row_idx, round(acc, 6) as acc, {PLAIN} as bucket from (select row_idx, {KEY_STRIP} as qkey from dpo_questions_24k_v2) left join a using (qkey)""",
    "semi_join_targets": f"select row_idx from student_responses where {KEY_STRIP} in (select {KEY_STRIP} from dpo_questions_24k_v2 where question is not null)",
    "anti_join_holdout": "select o_orderkey, o_orderpriority from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "inner_join_status": f"select s.qkey, g.teacher_status from (select {KEY_RAW} as qkey from {STUDENTS} where num_correct = 0) s join (select {KEY_RAW} as qkey, arg_max(teacher_status, row_idx) as teacher_status from warmstart_generations group by 1) g using (qkey)",
    "positional_zip": "select row_idx, a.ground_truth, b.predicted_answer from dpo_questions_24k_v2 a join warmstart_generations b using (row_idx)",
    "union_rounds": f"select round, count(*) as n, count(distinct qkey) as keys, count(num_total) as counted from (select {KEY_RAW} as qkey, 1 as round, null as num_total from dpo_questions_24k_v2 union all select {KEY_RAW}, 2, num_total from student_responses) group by round",
    "set_difference": f"select {KEY_RAW} as qkey from dpo_questions_24k_v2 except select {KEY_RAW} from student_responses",
    "pass_rates": f"select row_idx, num_correct, num_total, {KIND} as kind, num_correct < num_total and num_correct >= num_total // 2 as on_policy, num_correct < num_total and num_correct > 0 as mixed, num_correct < num_total // 2 as needs_teacher from {STUDENTS}",
    "pass_distribution": f"select kind, n, round(n / sum(n) over (), 6) as share from (select {KIND} as kind, count(*) as n from {STUDENTS} group by 1)",
    "wrong_counts": "select * from (select row_idx, num_correct as stored, len(list_filter(responses, lambda r: r.is_correct)) as counted from student_responses) where stored <> counted",
    "teacher_statuses": f"select case when a and b then 'both_correct' when a or b then 'one_correct' else 'none_correct' end as status, count(*) as n from (select coalesce(responses[1].is_correct, false) as a, coalesce(responses[2].is_correct, false) as b from {STUDENTS}) group by 1",
    "greedy_pairs": GREEDY,
    "pair_lengths": f"select median(length(chosen)) as median_chosen, median(length(rejected)) as median_rejected, round(avg(length(chosen)), 4) as mean_chosen, round(avg(length(rejected)), 4) as mean_rejected, round(avg(length(chosen) - length(rejected)), 4) as mean_diff, round(avg((length(chosen) < length(rejected))::int), 6) as share_shorter from ({GREEDY})",
    "chat_prompts": f"select row_idx, {q('<|im_start|>system' + chr(10) + preference.SYSTEM + '<|im_end|>' + chr(10) + '<|im_start|>user' + chr(10))} || question || {q('<|im_end|>' + chr(10) + '<|im_start|>assistant' + chr(10))} as prompt, {strip('question')} as back from dpo_questions_24k_v2",
    "benchmark_prompts": f"select item_id, regexp_replace(problem, '[{SPACE}]+$', '') || {q(chr(10) * 2 + preference.BOXED)} as boxed, {q(preference.STEP_PREFIX)} || regexp_replace(problem, '[{SPACE}]+$', '') || {q(preference.STEP_SUFFIX)} as steps, regexp_replace(problem, '[{SPACE}]+$', '') as none from eval_items",
    "few_shot_prompts": "select item_id, (select string_agg('Question: ' || problem || chr(10) || 'Answer: ' || solution || chr(10) || chr(10), '' order by item_id) from (select * from eval_items order by item_id limit 2)) || 'Question: ' || problem || chr(10) || 'Answer:' as prompt from eval_items",
    "answers_flat": f"""
select gen_id, pred, coalesce(case when gt = floor(gt) and abs(gt) < 1e9 then abs(v - gt) < 0.5 else abs(v - gt) / greatest(abs(gt), 1e-10) < 1e-4 or abs(v - gt) < 1e-4 end, false) as correct
from (select gen_id, pred, {ratio_number('pred')} as v, {ratio_number('ground_truth')} as gt from (select gen_id, ground_truth, {flat_boxed('full_response')} as pred from {GENERATIONS}))""",
    "answers_simple": f"select gen_id, {SIMPLE} as simple, {FIRST} as first, {STATED} as stated from {GENERATIONS}",
    "marked_answers": f"select row_idx, {empty_null(strip('replace(regexp_extract(t, ' + q('####' + chr(92) + 's*([' + chr(92) + '-' + chr(92) + 'd,' + chr(92) + '.]+)') + ', 1), ' + q(',') + ', ' + q('') + ')'))} as gold, regexp_replace(t, '<<[^>]+>>', '', 'g') as text from (select row_idx, answer || ' <<1+1=2>>' || chr(10) || '#### ' || ground_truth as t from dpo_questions_24k_v2)",
    "shared_runs": """
select gen_id, coalesce(list_has_any(case when length(a) >= 51 then list_transform(range(1, length(a) - 49), lambda i: a[i : i + 50]) else [] end, case when length(b) >= 51 then list_transform(range(1, length(b) - 49), lambda i: b[i : i + 50]) else [] end), false) as copied
from (select gen_id, continuation[1:3000] as a, (answer[length(prefix) + 1 :])[1:3000] as b from """
    + GENERATIONS
    + " where continuation is not null and answer is not null)",
    "line_penalties": f"select gen_id, round(least(0.03, 0.01 * (len(ls) - len(list_distinct(ls)))), 6)::double as penalty from (select gen_id, list_filter(list_transform(string_split(continuation, chr(10)), lambda l: lower({strip('l')})), lambda l: length(l) >= 20) as ls from {GENERATIONS} where continuation is not null)",
    "prefix_type_accuracy": f"select prefix_type, count(*) as total, count_if(is_correct) as n_correct, count(distinct case when is_correct then {KEY_RAW} end) as solved from {GENERATIONS} group by 1",
    "solve_rates": f"select count(*) as questions, count_if(solved) as n_solved, round(100 * avg(solved::int), 4) as rate, round(100 * avg(solved::int), 4) >= 5 as passed from (select bool_or(coalesce(is_correct, false)) as solved from {GENERATIONS} group by {KEY_RAW})",
    "accuracy_sets": f"select prefix_type, teacher_status, count_if(ok) as n_correct, count(*) as total, grouping(prefix_type, teacher_status)::bigint as level_id, round(count_if(ok) / count(*)::double, 6) as accuracy from (select prefix_type, teacher_status, coalesce(is_correct, false) as ok from {GENERATIONS}) group by grouping sets ((), (prefix_type), (teacher_status))",
    "accuracy_delta": f"with g as (select teacher_status, prefix_type, coalesce(is_correct, false)::int as ok from {GENERATIONS}) select a.teacher_status, a.v as base, b.v as tuned, round(b.v - a.v, 6) as delta from (select teacher_status, avg(ok) as v from g where prefix_type = 'short' group by 1) a join (select teacher_status, avg(ok) as v from g where prefix_type = 'long' group by 1) b using (teacher_status)",
    "wrong_examples": "select row_idx, predicted_answer, ground_truth from warmstart_generations where not is_correct order by row_idx limit 5",
    "source_shares": "select source, n, round(n / sum(n) over (), 6) as share from (select coalesce(source, 'none') as source, count(*) as n from documents group by 1)",
    "prompt_softmax": f"select gen_id, round(exp((r - m) / 0.5) / sum(exp((r - m) / 0.5)) over (partition by qkey), 6) as weight from (select gen_id, {KEY_RAW} as qkey, coalesce(is_correct, false)::int::double as r, max(coalesce(is_correct, false)::int::double) over (partition by {KEY_RAW}) as m from {GENERATIONS})",
    "lp_rates": f"select sample_id, is_pg, step, round(rate, 6) as rate from ({RATES})",
    "lp_states": f"select sample_id, round(p, 6) as p, round(lp, 6) as lp, n_updates, round(pg_p_ema, 6) as pg_p_ema, pg_seen from ({STATES})",
    "lp_stream": f"select sample_id, round(p, 6) as p, round(lp, 6) as lp, n_updates from ({STATES})",
    "lp_initial": f"select sample_id, round(arg_max(num_correct / greatest(num_total, 1)::double, row_idx), 6) as p, 0.0::double as lp, 1 as n_updates from (select *, {SAMPLE_ID} as sample_id from student_responses) group by 1",
    "lp_weights": f"select sample_id, round({WEIGHT}, 6) as weight, round(0.5 + 1.0 / (1 + exp(-10.0 * (0.7 * greatest(lp, 0) + 1.2 * p * (1 - p) - 0.08))), 6) as documented from ({STATES})",
    "lp_summary": f"select count(*) as n, round(avg(p), 6) as avg_p, round(avg(lp), 6) as avg_lp, count_if(p < 0.05) as n_hard, count_if(p between 0.1 and 0.5) as n_sweet, count_if(p > 0.8) as n_mastered, round(avg({WEIGHT}), 6) as avg_weight from ({STATES})",
    "lp_categories": f"select category, count(*) as n from (select unnest({LABELS}) as category from ({STATES})) group by 1",
    "lp_guided": f"select sample_id, n_updates from ({STATES}) where p <= 0.05 and n_updates >= 2 and lp <= 0.01",
    "lp_advantages": f"select o.sample_id, count(*) as n, round(sum({WEIGHT}), 4) as total from lp_observations o left join ({STATES}) s on s.sample_id = o.sample_id group by 1",
    "simple_pairs": SIMPLE_PAIRS,
    "answers_thinking": THINKING,
    "token_weights": TOKEN_WEIGHTS,
    "token_divergences": f"select vec_id, round({kl('s', 't')}, 6) as reverse_kl, round({kl('t', 's')}, 6) as forward_kl, round(-list_sum(list_transform(s, lambda x: exp(x) * x)), 6) as entropy, round(exp(t[1]), 6) as p_first from ({LOGS})",
}
