"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# crc32 over the bytes of a blob, by its table of 256 remainders.
_CRC = """
crc_table as (
  select list_transform(range(256), lambda x: list_reduce(
    [x::ubigint] || list_transform(range(8), lambda i: 0::ubigint),
    lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end)) as remainders)
"""


def _crc(blob: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::ubigint)"
    return (
        f"xor(list_reduce([4294967295::ubigint] || {bytes_}, "
        "lambda a, b: xor(remainders[((xor(a, b) & 255) + 1)::bigint], a >> 8)), 4294967295::ubigint)::bigint"
    )


def _draw(name: str, weight: int) -> str:
    return (
        f"-ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|{name}'), 1, 13))::bigint::double + 0.5)"
        f" / 4503599627370496.0) / {weight}.0"
    )


def _least(kind: str, weights: dict[int, int]) -> str:
    """The child of smallest draw, as SQL."""
    draws = ", ".join(f"{{'d': {_draw(f'{kind}{c}', w)}, 'c': {c}}}" for c, w in weights.items())
    return f"least({draws}).c"


_OLD = (
    "case region when 0 then case rack0 when 0 then {s01} else {s23} end "
    "else case rack1 when 2 then {s45} else {s67} end end"
).format(**{f"s{a}{a + 1}": _least("shard", {a: 1, a + 1: 1}) for a in (0, 2, 4, 6)})

OP5 = f"""
with {_CRC},
drawn as (
  select doc_id, text, {_least("region", {0: 4, 1: 4})} as region,
    {_least("region", {0: 4, 1: 4, 2: 1})} as new_region,
    {_least("rack", {0: 2, 1: 2})} as rack0, {_least("rack", {2: 2, 3: 2})} as rack1
  from documents),
placed as (
  select doc_id, coalesce(strlen(text), 0) + 1 as size,
    {_crc("encode(coalesce(text, ''))")} as text_crc32,
    {_OLD} as shard, case when new_region = 2 then 8 else {_OLD} end as grown_shard
  from drawn, crc_table)
select doc_id, size::bigint as size, text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot,
  grown_shard::int as grown_shard
from placed
"""

OP10 = """
with clean as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn, coalesce(role, 'unknown'), coalesce(text, '')) - 1 as pos
  from conversations),
ranked as (
  select conv_id, row_number() over (order by role, text, conv_id) - 1 as rank from clean where pos = 0),
sided as (
  select rank // 2 as pair_id, rank % 2 = 0 as is_chosen, pos, role, text from clean join ranked using (conv_id)),
common as (
  select pair_id, coalesce(min(pos) filter (where n < 2 or lo <> hi), max(pos) + 1) as common_turns
  from (select pair_id, pos, count(*) as n, min({'r': role, 't': text}) as lo, max({'r': role, 't': text}) as hi
        from sided group by pair_id, pos)
  group by pair_id),
lines as (
  select pair_id, case when pos < common_turns then 'prompt' when is_chosen then 'chosen' else 'rejected' end as part,
    pos, role, '<|im_start|>' || role || chr(10)
      || replace(replace(text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>')
      || '<|im_end|>' || chr(10) as segment
  from sided join common using (pair_id)
  where is_chosen or pos >= common_turns)
select pair_id, part, pos, role, segment, length(segment) as n_chars,
  (sum(length(segment)) over (partition by pair_id, part order by pos) - length(segment))::bigint as start,
  part <> 'prompt' and role = 'assistant' as trained
from lines
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP2 = f"""
with items as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as span
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
        from items where len(w) > 0)),
docs as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
spots as (
  select row, n, i, array_to_string(w[i:i + n - 1], ' ') as span
  from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i
        from docs, (select distinct n from windows) where len(w) >= n)),
found as (select row, i, spots.n, item_id from spots join windows on spots.n = windows.n and spots.span = windows.span),
hits as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + n)) as p from found) group by row),
named as (
  select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct row, item_id from found where item_id is not null) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (row) left join named using (row)
"""

_DOT = "list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))"

OP6 = f"""
with vectors as (
  select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm
  from (select vec_id, embedding::double[] as e from embeddings where embedding is not null)
  where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
scored as (
  select a.vec_id as query_id, b.vec_id, {_DOT} / (a.norm * b.norm) as score
  from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 5
"""

OP11 = """
with opened as (
  select row_number() over () as r, doc_id, coalesce(text, '') as body,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
windows as (
  select r, i, array_to_string(words[i:i + 7], ' ') as hit
  from (select r, words, unnest(range(1, greatest(len(words) - 6, 1))) as i from opened)),
again as (select r, i from windows qualify count(*) over (partition by r, hit) > 1),
covered as (
  select r, sum(reach) as n from (
    select r, least(8, coalesce(lead(i) over (partition by r order by i) - i, 8)) as reach from again) group by r),
measured as (
  select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words,
    len(list_filter(words, lambda w: regexp_matches(w, '\\p{L}'))) as n_letter,
    len(list_filter(lines, lambda l: regexp_matches(l, '^\\s*[-*•]'))) as n_bullet,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\\.\\.\\.|…)\\s*$'))) as n_cut
  from opened left join covered using (r)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words
    or 10 * n_letter < 8 * n_words or 2 * n_dup_lines > n_lines or 10 * n_bullet > 9 * n_lines
    or 10 * n_cut > 3 * n_lines) as kept
from judged
"""

OP12 = """
with hashed as (
  select doc_id, coalesce(text, '') as body, sha256('1:' || coalesce(doc_id::varchar, '')) as digest,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units
  from documents),
drawn as (
  select doc_id, body, units, len(units) as n,
    ('0x' || substr(digest, 1, 8))::bigint % (len(units) + 1) as a, ('0x' || substr(digest, 9, 8))::bigint % (len(units) + 1) as b,
    case when body = '' or regexp_matches(body, '<[PSM]>') or ('0x' || substr(digest, 17, 8))::bigint % 100 >= 90 then 'plain'
      when ('0x' || substr(digest, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from hashed),
parts as (
  select doc_id, body, n, form, array_to_string(units[1:least(a, b)], '') as prefix,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') as middle,
    array_to_string(units[greatest(a, b) + 1:], '') as suffix
  from drawn)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then body when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(body) as restored_sha256
from parts
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    return f"unnest(regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{_TERM}'))"


OP13 = f"""
with numbered as (select row_number() over () as r, doc_id, text from documents),
met as (select r, doc_id, {_terms("text")} as term from numbered),
counted as (select r, doc_id, term, count(*) as tf from met group by all),
lengths as (select r, count(*) as n from met group by r),
corpus as (select count(*) as docs, sum(n)::bigint as terms from lengths),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
  from counted, corpus group by term),
asked as (select distinct item_id, {_terms("text")} as term from benchmark),
scores as (
  select item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::bigint as score
  from asked join counted using (term) join weights using (term) join lengths using (r), corpus
  group by item_id, r, doc_id having score > 0)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank, doc_id, score
from scores qualify rank <= 50
"""

ORACLE = {
    "op6_neighbours": OP6,
    "op2_decontamination": OP2,
    "op5_sharding": OP5,
    "op10_preferences": OP10,
    "op11_quality_rules": OP11,
    "op12_fill_in_middle": OP12,
    "op13_lexical_search": OP13,
}
