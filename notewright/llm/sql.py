"""DuckDB SQL of the corpus queries that SQL can state over whole tables."""

from __future__ import annotations

from notewright.llm import resample
from notewright.llm.quality import RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _fails(base_only: bool) -> str:
    return " or ".join(
        f"{r.scale} * {r.measure} {'<' if r.side == 'below' else '>'} {r.bound}{'' if r.per is None else ' * ' + r.per}"
        for r in RULES if r.base or not base_only
    )


QUALITY_FIGURES = rf"""
with cut as (
  select row_number() over () as rn, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), grams as (
  select rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rn, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from cut)
), places as (
  select rn, i from (select rn, i, count(*) over (partition by rn, g) as n from grams) where n > 1
), covered as (
  select rn, count(distinct i + d) as n from places, (values (0), (1), (2)) as o(d) group by rn
), figures as (
  select cut.rn, doc_id, len(w)::bigint as n_words,
         length(array_to_string(w, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as rows_,
         coalesce(covered.n, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: lower(x) in ({_STOP})))::bigint as n_stop_words
  from cut left join covered using (rn)
), counted as (
  select *, len(rows_)::bigint as n_lines, (len(rows_) - len(list_distinct(rows_)))::bigint as n_dup_lines from figures
)"""

# CRC-32 of the UTF-8 bytes of distinct runs of words: a table of 256 steps, then one step a byte.
RESAMPLING = rf"""
with cut as (
  select row_number() over () as rn, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), target_words as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as g
  from benchmark
), steps as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) as r(i)
), runs as (
  select rn, unnest(w) as g from cut
), kinds as (
  select g from runs union select g from target_words
), hashed as (
  select g, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(g))), lambda i:
      (16 * (instr('0123456789ABCDEF', substr(hex(encode(g)), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(g)), 2 * i + 2, 1)) - 1)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {resample.BUCKETS} as bucket
  from kinds, steps
), found as (
  select rn, bucket from runs join hashed using (g)
), corpus as (
  select bucket, count(*) as s from found group by bucket
), wanted as (
  select bucket, count(*) as t from target_words join hashed using (g) group by bucket
), gains as (
  select bucket, floor({resample.SCALE} * ln(
    (coalesce(t, 0)::double + 1) * ((select count(*) from found) + {resample.BUCKETS})::double
    / ((s::double + 1) * ((select count(*) from target_words) + {resample.BUCKETS})::double)))::bigint as gain
  from corpus left join wanted using (bucket)
), weights as (
  select rn, count(*) as n, sum(gain)::bigint as total from found join gains using (bucket) group by rn
), scored as (
  select cut.rn, doc_id, coalesce(n, 0)::bigint as n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
         ('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from cut left join weights using (rn)
), noisy as (
  select *, weight + floor(-{resample.SCALE} * ln(-ln((h::double + 0.5) / 4294967296)))::bigint as score from scored
), placed as (
  select rn, row_number() over (order by score desc, doc_id) as place from noisy where n_features >= {resample.LEAST_WORDS}
)
select doc_id, n_features, weight, score,
       case when place <= {resample.PERCENT} * (select count(*) from placed) // 100 then place end as rank
from noisy left join placed using (rn)"""

SQL = {
    "op13_resampling": RESAMPLING,
    "op10_quality_rules": f"""{QUALITY_FIGURES}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_fails(True)}) as base_failed, not ({_fails(False)}) as kept
from counted""",
}
