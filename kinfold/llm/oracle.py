"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from kinfold.llm.quality import FURNITURE, FURNITURE_WORDS, MAX_LOST, MENU

_WS = r"'[\x20\x09-\x0D]+'"


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {_WS}), lambda w: w <> '')"


def _left(x: str, negated: str) -> str:
    return f"length(regexp_replace({x}, '{negated}', '', 'g'))"


QUALITY = f"""
with d as (select doc_id, text, coalesce(text, '') as t from documents),
own as (select doc_id, text, t, {_split('t')} as ws from d),
grams as (select doc_id, i, array_to_string(ws[i + 1 : i + 5], ' ') as g
  from (select doc_id, ws, unnest(range(len(ws) - 4)) as i from own where len(ws) >= 6)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
rep as (select doc_id, count(distinct i + k) as n from twice, range(5) as r(k) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as p from d),
sized as (select *, len({_split('line')}) as n, length(array_to_string({_split('line')}, '')) as chars from lines),
ruled as (select *, case when n = 0 then ''
  when ((length(line) - length(replace(line, '!!', ''))) / 2 * 4 >= n and (length(line) - length(replace(line, '!!', ''))) / 2 >= 2)
    or ({_left('line', '[^#*$%&<>]+')} * 2 >= n and {_left('line', '[^#*$%&<>]+')} >= 4)
    or (n >= 40 and {_left('line', '[^.!?:;,]+')} = 0) then 'punctuation'
  when ({_left('line', '[^|»·]+')} >= 3 and {_left('line', '[^|»·]+')} * 5 >= n)
    or ((length(line) - length(replace(line, '://', ''))) / 3 >= 2 and (length(line) - length(replace(line, '://', ''))) / 3 * 2 >= n) or (n <= 3 and regexp_matches(trim(lower(line)), '^{MENU}$')) then 'navigation'
  when n <= {FURNITURE_WORDS} and regexp_matches(lower(line), '{FURNITURE}') then 'boilerplate' else '' end as rule from sized),
byline as (select doc_id,
  count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines,
  count(*) filter (rule = 'punctuation') as n_punctuation, count(*) filter (rule = 'navigation') as n_navigation,
  count(*) filter (rule = 'boilerplate') as n_boilerplate, coalesce(sum(chars) filter (rule <> ''), 0)::bigint as lost_chars,
  coalesce(string_agg(line, chr(10) order by p) filter (rule = ''), '') as clean_text from ruled group by doc_id),
facts as (select o.doc_id, o.text, len(o.ws)::bigint as n_words, length(array_to_string(o.ws, ''))::bigint as word_chars,
  {_left('o.t', '[^#*$%&|<>]+')}::bigint as n_symbols, coalesce(r.n, 0)::bigint as n_repeat_words, b.* exclude (doc_id)
  from own o left join rep r using (doc_id) join byline b on b.doc_id = o.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost_chars * 100 <= word_chars * {MAX_LOST} as kept,
  n_punctuation, n_navigation, n_boilerplate, lost_chars, case when text is not null then clean_text end as clean_text
from facts"""

_STRIP = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP = f"""
with raw as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p
  from documents where text is not null),
lines as (select *, {_STRIP} as s from raw),
spread as (select s from lines where s <> '' group by s having count(distinct coalesce(source, '')) >= 10 and count(distinct text) >= 10),
firsts as (select s, min(doc_id) as first_id from lines semi join spread using (s) group by s),
judged as (select l.*, f.first_id, row_number() over (partition by l.doc_id, l.s order by p) as nth from lines l left join firsts f using (s)),
kept as (select *, first_id is null or (first_id = doc_id and nth = 1) as keep from judged)
select d.doc_id, coalesce(count(k.s) filter (k.s <> ''), 0) as n_lines, coalesce(count(k.s) filter (not k.keep), 0) as n_removed,
  case when d.text is not null then coalesce(string_agg(k.line, chr(10) order by k.p) filter (k.keep), '') end as text
from documents d left join kept k on k.doc_id = d.doc_id group by d.doc_id, d.text"""

_ASCII_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bench_words(x: str) -> str:
    low = _ASCII_LOWER.format(x=f"coalesce({x}, '')")
    return rf"list_filter(regexp_split_to_array({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


DECONTAMINATION = f"""
with items as (select item_id, {_bench_words('text')} as ws from benchmark),
wins as (select distinct item_id, n, array_to_string(ws[i + 1 : i + n], ' ') as g
  from (select item_id, ws, least(10, len(ws)) as n, unnest(range(len(ws) - least(10, len(ws)) + 1)) as i from items where len(ws) > 0)),
docs as (select doc_id, {_bench_words('text')} as ws from documents),
grams as (select doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') as g
  from (select doc_id, ws, n, unnest(range(len(ws) - n + 1)) as i from docs, (select distinct n from wins) where len(ws) >= n)),
found as (select distinct doc_id, item_id, n, i from grams join wins using (n, g)),
hit as (select doc_id, count(distinct i + k) as n_hit from found, range(10) as r(k) where k < n group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names
  from (select distinct doc_id, item_id from found where item_id is not null) group by doc_id)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(m.n_items, 0)::bigint as n_items,
  sha256(coalesce(m.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h using (doc_id) left join named m using (doc_id)"""

ORACLES = {
    "op1_quality_rules": QUALITY,
    "op6_line_dedup": LINE_DEDUP,
    "op9_decontamination": DECONTAMINATION,
}
