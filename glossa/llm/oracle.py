"""SQL for DuckDB of the queries of this subpackage that SQL can express.

Near-duplicate texts, trained models, codecs, tokenizers, packing and the iterative sharding
have none; tests hold them against brute force, exact round trips or held-out accuracy.
The patterns of personal data look behind, which DuckDB's do not; tests compare them with
the plain patterns. The mixing schedule is tested against a simulation slot by slot.
The merge's codes are CRC sums, which are written out here byte by byte from their table.
"""

from __future__ import annotations

from glossa.llm.quality_rules import STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

QUALITY_RULES = rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select r, unnest(range(1, len(w) - 3)) i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) gram from w where len(w) >= 5),
two as (select r, gram from g group by 1, 2 having count(*) > 1),
p as (select g.r, g.i, least(5, coalesce(lead(g.i) over (partition by g.r order by g.i) - g.i, 5)) n from g join two on g.r = two.r and g.gram = two.gram),
c as (select r, sum(n)::bigint n_repeat_words from p group by 1),
m as (select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
  coalesce(n_repeat_words, 0) n_repeat_words, len(l) n_lines, len(list_distinct(list_filter(w, lambda x: x in ({_STOP})))) n_stop, len(list_filter(w, lambda x: x = upper(x) and x <> lower(x))) n_capital
  from w left join c on w.r = c.r),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, concat_ws(',', case when n_words < 10 then 'words' end,
  case when word_chars::double / greatest(n_words, 1) < 2 or word_chars::double / greatest(n_words, 1) > 14 then 'word_length' end,
  case when n_symbols::double / greatest(n_words, 1) > 0.25 then 'symbols' end, case when n_repeat_words::double / greatest(n_words, 1) > 0.2 then 'repeated_words' end,
  case when n_dup_lines::double / greatest(n_lines, 1) > 0.4 then 'repeated_lines' end, case when n_stop < 1 then 'stop_words' end,
  case when n_capital::double / greatest(n_words, 1) > 0.35 then 'capitals' end) broken from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and broken = '' kept, broken from b
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CUT = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
_WEIGHT = "floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint"

RANKED = f"""
with d as (select row_number() over () r, doc_id, {_CUT} t from documents), n as (select r, doc_id, len(t) n from d where len(t) > 0),
c as (select count(*) docs, sum(n)::bigint len from n), tf as (select r, term, count(*) tf from (select r, unnest(t) term from d) group by 1, 2),
df as (select term, count(*) df from tf group by 1), q as (select row_number() over () i, item_id, {_CUT} t from benchmark),
qt as (select i, item_id, term, count(*) k from (select i, item_id, unnest(t) term from q) group by 1, 2, 3),
s as (select i, item_id, tf.r, doc_id, sum(k * {_WEIGHT} * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::bigint score
  from qt join tf on qt.term = tf.term join df on df.term = tf.term join n on n.r = tf.r, c group by 1, 2, 3, 4),
k as (select *, row_number() over (partition by i order by score desc, doc_id nulls last)::int "rank" from s where score > 0)
select item_id, "rank", doc_id, score from k where "rank" <= 20
"""

_COSINE = "list_cosine_similarity(a.v, b.v)"
NEAR_VECTORS = f"""
with recursive x as (select row_number() over () r, vec_id, embedding::double[] v from embeddings),
ok as (select * from x where len(v) > 0 and len(list_filter(v, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(v, lambda y: y <> 0)) > 0),
l as (select a.r a, b.r b from ok a join ok b on a.r <> b.r and len(a.v) = len(b.v) and {_COSINE} >= 0.9),
reach as (select r a, r b from x union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select reach.a r, min(x.vec_id) component_id from reach join x on x.r = reach.b group by 1), n as (select a r, count(*) n_links from l group by 1)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id is not distinct from component_id kept from x join c using (r) left join n using (r)
"""

_SUM = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda b: ascii(b)::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 7"
_CODED = lambda branch, name: _SUM.format(f"'{branch}:' || coalesce(doc_id::varchar, '') || ':' || {name}")
_EDIT = lambda code, v: f"case {code} when 1 then {v} || '!' when 2 then {v} || '?' else {v} end"
_BOTH = "case when {0} is distinct from {2} then {0} else {1} end"  # right where it changed, else left
_MARK = lambda code: f"case {code} when 3 then '!' when 4 then '?' end"
_FIGHT = "(l{0} is distinct from {1} and r{0} is distinct from {1} and l{0} is distinct from r{0})"

MERGED = f"""
with t as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))) crc),
d as (select distinct doc_id, coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source from documents),
h as (select d.*, row_number() over () r, {_CODED('L', "'row'")} lr, {_CODED('R', "'row'")} rr, {', '.join(f"{_CODED(b, repr(c))} {b.lower()}_{c}" for b in "LR" for c in ("lang", "source"))} from d, t),
x as (select r, doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) n from h),
y as (select x.*, {_CODED('L', 'n::varchar')} lc, {_CODED('R', 'n::varchar')} rc from x, t),
z as (select y.r, n, line base, case when lr = 0 then line when lc = 0 then null else {_EDIT('lc', 'line')} end ll, case when rr = 0 then line when rc = 0 then null else {_EDIT('rc', 'line')} end rl,
  case when lr = 0 then null else {_MARK('lc')} end lg, case when rr = 0 then null else {_MARK('rc')} end rg from y join h on y.r = h.r),
w as (select r, coalesce(string_agg(v, chr(10) order by n, k), '') text, sum(clean)::bigint clean, sum(ee)::bigint ee, sum(ed)::bigint ed, sum(ii)::bigint ii from (
  select r, n, 0 k, {_BOTH.format('rl', 'll', 'base')} v, ((ll is distinct from base or rl is distinct from base) and not {_FIGHT.format('l', 'base')})::int clean,
    ({_FIGHT.format('l', 'base')} and ll is not null and rl is not null)::int ee, ({_FIGHT.format('l', 'base')} and (ll is null or rl is null))::int ed, 0 ii from z union all
  select r, n, 1, coalesce(rg, lg), ((lg is not null or rg is not null) and not (lg is not null and rg is not null and lg <> rg))::int, 0, 0, (lg is not null and rg is not null and lg <> rg)::int from z) group by 1),
c as (select r, max(case when name = 'lang' then v end) lang, max(case when name = 'source' then v end) source, sum(clean)::bigint clean, sum(ee)::bigint ee from (
  select r, name, {_BOTH.format('rv', 'lv', 'base')} v, ((lv <> base or rv <> base) and not (lv <> base and rv <> base and lv <> rv))::int clean, (lv <> base and rv <> base and lv <> rv)::int ee from (
    select r, 'lang' name, lang base, case when lr = 0 then lang when l_lang = 0 then '' else {_EDIT('l_lang', 'lang')} end lv, case when rr = 0 then lang when r_lang = 0 then '' else {_EDIT('r_lang', 'lang')} end rv from h union all
    select r, 'source', source, case when lr = 0 then source when l_source = 0 then '' else {_EDIT('l_source', 'source')} end, case when rr = 0 then source when r_source = 0 then '' else {_EDIT('r_source', 'source')} end from h)) group by 1),
o as (select h.doc_id, h.lr, h.rr, c.lang, c.source, w.text, c.clean + w.clean clean, c.ee + w.ee ee, w.ed, w.ii, c.clean + w.clean + c.ee + w.ee + w.ed + w.ii changed from h join c on c.r = h.r join w on w.r = h.r),
s as (select *, lr = 0 or rr = 0 gone, (lr = 0) <> (rr = 0) and changed > 0 fight, lr <> 0 and rr <> 0 or (lr = 0 and rr <> 0 and changed > 0) here from o),
a as (select -1 - doc_id doc_id, max(case when lr in (3, 4) then {_MARK('lr')} end) l, max(case when rr in (3, 4) then {_MARK('rr')} end) r, max(lang) lang, max(source) source from h where lr in (3, 4) or rr in (3, 4) group by 1)
select doc_id, case when here then lang end lang, case when here then source end source, case when here then sha256(text) end text_sha256, case when gone then (not fight)::bigint else clean end n_clean,
  case when gone then 0 else ee end n_edit_edit, case when gone then fight::bigint else ed end n_edit_delete, case when gone then 0 else ii end n_insert_insert from s union all
select doc_id, lang, source, sha256(coalesce(r, l)), (l is null or r is null or l = r)::bigint, 0, 0, (l is not null and r is not null and l <> r)::bigint from a
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": QUALITY_RULES, "op11_treaps": RANKED, "op12_tiles": NEAR_VECTORS, "op13_merge": MERGED}
