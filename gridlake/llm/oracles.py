"""DuckDB SQL for the operators that SQL can express on whole tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Marks and the space inside them: <s>; [INST] x [/INST]; [OUT] x </s>; [SYS] x [/SYS]; [NEXT] between turns.
_CONTROL = r"(\\*(?:<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|\[SYS\]|\[/SYS\]|\[ROLE\]|\[AS\]|\[/ROLE\]|\[NEXT\]|\[NULL\]))"
OP3 = rf"""
with t as (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), m as (
    select *, length(regexp_replace(text, '{_CONTROL}', '\\\1', 'g')) as escaped,
        case when role = lag(role) over (partition by conv_id order by turn) then 8 else case role when 'user' then 15 when 'assistant' then 11 else 13 end end as marks
    from t
)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256, cast(3 + sum(escaped + marks) as bigint) as formatted_chars
from m group by conv_id
"""

OP5 = f"""
with l as (
    select doc_id, k, lines[k] as line, {_LOWER.format(f"trim(lines[k], {_SPACE})")} as key
    from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as k from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents) a) b
), f as (
    select key, max(doc_id) as last from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5
)
select l.doc_id, count(*) as n_lines, count(*) filter (where f.key is not null and f.last <> l.doc_id) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by k) filter (where f.key is null or f.last = l.doc_id), '')) as kept_sha256
from l left join f on f.key = l.key group by l.doc_id
"""

OP6 = f"""
with d as (
    select doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents
), w as (
    select doc_id, unnest(w) as word from d
), c as (
    select doc_id, sum(n) as n_words, sum(n * length(word)) as word_chars, max(n) as same from (select doc_id, word, count(*) as n from w group by 1, 2) x group by 1
), g as (
    select doc_id, i, array_to_string(w[i : i + 2], ' ') as three from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2) x
), h as (
    select g.doc_id, count(distinct g.i + o.k) as again from g join (select doc_id, three from g group by 1, 2 having count(*) > 1) r on r.doc_id = g.doc_id and r.three = g.three, (values (0), (1), (2)) o(k) group by 1
), l as (
    select doc_id, count(*) - count(distinct line) as dup from (select doc_id, unnest(string_split(t, chr(10))) as line from d) x where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1
), s as (
    select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup, 0) as n_dup_lines,
        coalesce(again, 0) as n_repeat_words, coalesce(same, 0) as same, len(string_split(t, chr(10))) as lines, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) as digits,
        length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g')) as marks
    from d left join c using (doc_id) left join h using (doc_id) left join l using (doc_id)
), b as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed from s
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
    cast(n_repeat_words as bigint) as n_repeat_words, failed as base_failed,
    not failed and not (2 * n_symbols > n_words or 2 * n_dup_lines > lines or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * digits > greatest(word_chars, 1)
        or 10 * marks > 4 * greatest(word_chars, 1) or 10 * same > 4 * n_words) as kept
from b
"""

OP10 = f"""
with recursive d as (
    select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents
), s as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0) x
), n as (
    select doc_id, count(*) as n from s group by 1
), p as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), l as (
    select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), e as (
    select a, b from l union all select b, a from l
), r(doc_id, o) as (
    select a, a from e union select r.doc_id, e.b from r join e on e.a = r.o
)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, coalesce(min(r.o), d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id left join r on r.doc_id = d.doc_id group by d.doc_id
"""

ORACLES = {"op3_chat_format": OP3, "op5_line_dedup": OP5, "op6_quality": OP6, "op10_ngram_jaccard": OP10}
