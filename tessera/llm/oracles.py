"""DuckDB statements with the same results as the queries of this subpackage, where SQL can say it."""

from __future__ import annotations

from tessera.functions.words import HAN_RANGES, HIDDEN_RANGES
from tessera.llm.packing import SPACES
from tessera.llm.quota_sample import PLAIN, WIDE


def _ranges(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


SPACE, HIDDEN, HAN = _ranges(SPACES), _ranges(HIDDEN_RANGES), _ranges(HAN_RANGES)


def _plain(c: str) -> str:
    quoted = PLAIN.replace("'", "''")
    return f"lower(regexp_replace(translate({c}, '{WIDE}', '{quoted}'), '[{SPACE}]+', '', 'g'))"


P1_REPORT = f"""
with keys as (
  select distinct plan_id, category_id, unnest([{_plain('category')}, {_plain('name_en')}]) as key from category_targets
), held as (
  select k.plan_id, k.category_id, count(distinct q.question_id) as available
  from keys k join (select question_id, {_plain('category')} as key from dpo_questions_24k_v2) q on q.key = k.key and k.key <> '' group by all
)
select t.plan_id, t.category_id, coalesce(h.available, 0) as available,
       greatest(t.min_rows, cast(ceil(round(t.target_share * t.sample_rows, 4)) as bigint)) as needed
from category_targets t left join held h using (plan_id, category_id)
"""

_WORDS = f"regexp_extract_all(lower(regexp_replace(text, '[{HIDDEN}]', '', 'g')), '[\\pL\\pN]+')"

P2_FOUND = f"""
with recs as (
  select 'sample_input' as rec_table, id as rec_key, text from sample_input
  union select 'warmstart_generations', cast(gen_id as varchar), continuation from warmstart_generations
), told as (
  select rec_table, rec_key, row_number() over () as n, {_WORDS} as words,
         len(regexp_extract_all(text, '[{HAN}]')) as han, len(regexp_extract_all(regexp_replace(text, '[{HAN}]', ' ', 'g'), '[\\pL\\pN]+')) as other
  from recs where text is not null and rec_key is not null
), units as (
  select rec_table, rec_key, n, case when han > 0 and han > other then string_split(array_to_string(words, ''), '') else words end as u,
         case when han > 0 and han > other then 10 else 5 end as run
  from told
), spots as (
  select n, run, rec_table, rec_key, unnest(u) as unit, unnest(range(1, len(u) + 1)) as i, u from units where len(u) > 0
), grams as (
  select n, run, rec_table, rec_key, unit, i, case when i + run - 1 <= len(u) then array_to_string(u[i : i + run - 1], ' ') end as gram from spots
), again as (
  select n, run, rec_table, rec_key, unit, i, gram is not null and row_number() over (partition by n, gram order by i) > 1 as rep from grams
), covered as (
  select rec_table, rec_key, n, length(unit) as size, max(case when rep then i else -100 end) over (partition by n order by i rows unbounded preceding) > i - run as hit from again
)
select rec_table, rec_key from (select rec_table, rec_key, n, sum(case when hit then size else 0 end) / sum(size) as share from covered group by all) where share >= 0.3 group by all
"""

P7_TOKENS = f"""
select doc_id,
  len(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\\pL+| ?\\pN+| ?[^{SPACE}\\pL\\pN]+|[{SPACE}]+'))
  + len(regexp_extract_all(text, '[{SPACE}][{SPACE.replace(chr(92) + "x{20}-" + chr(92) + "x{20}", "")}][^{SPACE}]')) as tokens
from documents
"""

P7_FOUND = f"select w.window_id, d.doc_id from ({P7_TOKENS}) d, context_windows w where d.tokens > w.capacity_tokens"

P8_FOUND = f"""
with d as (select doc_id, {_WORDS} as w from documents),
dg as (select doc_id, array_to_string(w[i : i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
e as (select item_id, {_WORDS} as w from (select item_id, unnest([problem, solution]) as text from eval_items)),
eg as (select distinct item_id, array_to_string(w[i : i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e))
select distinct doc_id, item_id from dg join eg using (g)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"select plan_id, category_id from ({P1_REPORT}) where available < needed",
    "p2_found": P2_FOUND,
    "p7_found": P7_FOUND,
    "p8_found": P8_FOUND,
    "p8_items": f"select item_id, count(*) as documents from ({P8_FOUND}) group by item_id",
}
