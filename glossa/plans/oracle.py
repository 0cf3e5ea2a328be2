"""SQL of the registered queries for DuckDB, written independently of the plans."""

from __future__ import annotations

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\p{Z}]"
_DASH = r"\-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2212}"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _normal(x: str) -> str:
    return _squeeze(f"lower({x})")


def _key(x: str) -> str:
    return f"regexp_replace({x}, '[{_DASH}]|{_WS}', '', 'g')"


def _other(k: str) -> str:
    return f"case when {k} like '%s' and length({k}) > 1 then left({k}, length({k}) - 1) else {k} || 's' end"


def _limit(x: str) -> str:
    return f"case when length({_key(x)}) <= 4 then 1.0::double when length({_key(x)}) <= 7 then 0.95::double else 0.9::double end"


def _short(x: str) -> str:
    return f"(length({_key(x)}) > 1 and (regexp_matches({x}, '[\\p{{Lu}}\\p{{Nd}}+/-]') or (length({_key(x)}) <= 12 and position(' ' in trim({x})) = 0)))"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\p{{Z}}]')"


def _singular(w: str) -> str:
    return (
        f"case when {w} not like '%s' then {w} when {w} like '%viruses' then left({w}, length({w}) - 4) || 'us' "
        f"when {w} like '%ies' and {w} not like '%eies' and {w} not like '%aies' then left({w}, length({w}) - 3) || 'y' "
        f"when {w} like '%es' and {w} not like '%aes' and {w} not like '%ees' and {w} not like '%oes' then (case when {w} like '%sses' then left({w}, length({w}) - 2) else left({w}, length({w}) - 1) end) "
        f"when {w} like '%us' or {w} like '%ss' then {w} else left({w}, length({w}) - 1) end"
    )


def _plural(x: str) -> str:
    return f"array_to_string(list_transform({_tokens(x)}, lambda w: {_singular('w')}), ' ')"


def _set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_normal(x)}, ' '), lambda w: w <> ''))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _paren(a: str, b: str) -> str:
    side = lambda x, y: f"len(list_filter(regexp_extract_all({x}, '\\(([^()]*)\\)', 1), lambda p: {_normal('p')} = {_normal(y)})) > 0"
    return f"({side(a, b)} or {side(b, a)})"


def _relaxed(x: str) -> str:
    t = f"regexp_replace(translate({_normal(x)}, '’‘`“”', '''''''\"\"'), '[\\x{{2010}}\\x{{2011}}\\x{{2012}}\\x{{2013}}\\x{{2014}}\\x{{2212}}_-]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '^[\\s.,;:()\\[\\]{{}}]+', ''), '[\\s.,;:()\\[\\]{{}}]+$', '')"
    return _squeeze(f"regexp_replace({t}, '\\bcells\\b', 'cell', 'g')")


_LAST = """case when w like '%ies' and length(w) > 4 and w not in ('species', 'series') then left(w, length(w) - 3) || 'y'
  when regexp_matches(w, '(sses|shes|ches|xes|zes)$') and length(w) > 4 then left(w, length(w) - 2)
  when w like '%s' and length(w) > 3 and not regexp_matches(w, '(ss|us|is)$') then left(w, length(w) - 1) else w end"""

_W2 = "([^A-Za-z]*)([A-Za-z]+)"
_UNICODE = r"([^\p{L}\p{N}]*)([\p{L}\p{N}]+)"


def _words(name: str = "words", table: str = "documents", key: str = "doc_id", pattern: str = _W2) -> str:
    return f"""{name}_raw as (select {key}, unnest(regexp_extract_all(text, '{pattern}', 1)) gap, unnest(regexp_extract_all(text, '{pattern}', 2)) token,
      unnest(range(len(regexp_extract_all(text, '{pattern}', 2)))) pos from {table}),
    {name} as (select {key}, pos, token, cast(sum(length(gap) + length(token)) over (partition by {key} order by pos) as bigint) - length(token) s,
      cast(sum(length(gap) + length(token)) over (partition by {key} order by pos) as bigint) e from {name}_raw)"""


_IDS = """ids as (select p_partkey id, p_brand passage_key, p_type "type", case p_partkey % 7 when 0 then 'CL:' || p_partkey when 1 then '(skos:exact)CL:' || p_partkey
  when 2 then '(skos:related)CL:' || p_partkey when 3 then 'CL:' || p_partkey || ';CL:' || p_size when 4 then 'cl_' || p_partkey || ', CL:' || p_size when 5 then '-' else 'None' end x from part)"""
_CLEAN = "trim(replace(replace(x, '(skos:exact)', ''), '(skos:related)', ''))"
_PARTS = f"list_filter(list_transform(regexp_split_to_array({_CLEAN}, '[;,]'), lambda p: trim(p)), lambda p: lower(p) not in ('', '-', 'none'))"
_GOLD = f"""single as (select *, {_CLEAN} gold_id from ids where x not in ('-', 'None') and position(';' in x) = 0 and position(',' in x) = 0),
 gold as (select 'singleID' gate, id, passage_key, "type", gold_id from single union all
  select 'exactIDsOnly', id, passage_key, "type", gold_id from single where x not like '(skos:related)%' union all
  select 'allLabels', id, passage_key, "type", unnest({_PARTS}) from ids)"""
_PREFIX = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 2))), '{0}')"
_ABBR = f"""abbr as (select case when p_partkey % 2 = 0 then {_PREFIX.format('-')} else {_PREFIX.format('')} end short_form, 'CL:' || p_size identifier, p_partkey line from part),
 lookup as (select {_key('short_form')} k, count(distinct identifier) n_ids, count(*) n_rows, arg_max(short_form, length(short_form) * 1000000000 - line) short_form,
  arg_max(identifier, length(short_form) * 1000000000 - line) identifier from abbr group by 1)"""
_MENTIONS = f"""mentions as (select distinct {_PREFIX.format(' ')} || case when p_partkey % 3 = 0 then 's' else '' end mention, 'd' || (p_partkey % 50) doc_key from part)"""
_DEFINED = f"""defined as (select 'd' || (p_partkey % 50) doc_key, {_PREFIX.format('')} || case when p_partkey % 2 = 0 then 's' else '' end k, arg_max(p_name, p_partkey) long_form from part group by 1, 2)"""
_CASCADE = f"""wanted as (select distinct doc_key, {_key('mention')} k from mentions),
 hits as (select w.doc_key, w.k, 1 prio, 'exact_key' "method", d.k matched_key, d.long_form from wanted w join defined d on w.doc_key = d.doc_key and w.k = d.k
  union all select w.doc_key, w.k, 2, 'exact_variant', d.k, d.long_form from wanted w join defined d on w.doc_key = d.doc_key and d.k = ({_other('w.k')})),
 cascade as (select doc_key, k, arg_min("method", prio) "method", arg_min(matched_key, prio) matched_key, arg_min(long_form, prio) long_form from hits group by 1, 2)"""
_RESOLVE = f"""resolved as (select m.doc_key, m.mention, case when l.k is null then 'none' when n_ids = 1 then 'direct' when c.long_form is not null then 'ambiguous_long_form' else 'ambiguous_unresolved' end kind,
  case when n_ids = 1 then l.identifier end identifier, case when n_ids > 1 then c.long_form end long_form
  from mentions m left join lookup l on l.k = {_key('m.mention')} and {_short('m.mention')} left join cascade c on c.doc_key = m.doc_key and c.k = {_key('m.mention')})"""
_COS = "1 - list_cosine_similarity({0}.embedding::double[], {1}.embedding::double[])"
_NEAR = f"""near as (select q.vec_id query_id, t.vec_id, t.label, round({_COS.format('q', 't')}, 9) distance from embeddings q, embeddings t where q.vec_id % 50 = 0),
 top as (select *, row_number() over (partition by query_id order by distance, vec_id) "rank" from near qualify "rank" <= 20)"""
_LOGITS = "logits as (select vec_id // 3 token, unnest(range(64)) label, unnest(embedding)::double logit from embeddings), means as (select token, label, avg(logit) m, count(*) n from logits group by 1, 2)"
_GAZ = f"{_words('bench', 'benchmark', 'item_id')}, gaz as (select lower(token) term, min(item_id) concept from bench group by 1)"
_SPANS = """gold as (select doc_id passage_key, pos id, case when token like '%ing' then 'ing' else 'tion' end "type", s, e from words where regexp_matches(token, '(ing|tion)$')),
 pred as (select doc_id passage_key, pos id, case when token like '%ing' then 'ing' else 'tion' end "type", case when pos % 3 = 0 then greatest(s - 4, 0) else s end s, e from words where regexp_matches(token, '(ing|ion)$') and length(token) >= 6)"""
_ENT = """ent as (select doc_id, pos entity, case when token like '%ing' then 'ing' else 'tion' end label, s + length(token) // 2 s, e + 12 e from words where regexp_matches(token, '(ing|tion)$'))"""
_OWN = """own as (select w.doc_id, w.pos, max(x.entity) entity from words w join ent x on w.doc_id = x.doc_id and w.s < x.e and x.s < w.e {0} group by 1, 2),
 tagged as (select w.doc_id, w.pos, case when o.entity is null then 'O' when o.entity = lag(o.entity) over (partition by w.doc_id order by w.pos) then 'I-' || x.label else 'B-' || x.label end tag
  from words w left join own o on w.doc_id = o.doc_id and w.pos = o.pos left join ent x on x.doc_id = o.doc_id and x.entity = o.entity)"""
_SKIP = "and not exists (select 1 from words v where v.doc_id = x.doc_id and v.s < x.e and x.s < v.e and (v.s < x.s or v.e > x.e))"
_PRF = "round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 9) \"precision\", round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 9) recall, round(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 9) f1"
_PRED = """pred as (select passage_key, "type", id, r, 'CL:' || (id + r - 3) pred_id, (99 - r * 7) score from ids, range(12) t(r) where (id + r) % 9 <> 0 {0}),
 placed as (select *, row_number() over (partition by passage_key, "type", id order by r) - 1 place from pred)"""
_TERMS = f"""raw as (select p_brand concept, {_squeeze("case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then ' ' || replace(p_name, ' ', '  ') else p_name end")} term, p_partkey ord from part),
 once as (select *, row_number() over (partition by concept, lower(term) order by ord) n from raw qualify n = 1),
 terms as (select concept, term, row_number() over (partition by concept order by ord, lower(term)) - 1 pos from once)"""
_CN = "cn as (select distinct p_brand concept, case when p_partkey % 2 = 0 then p_name else p_name || ' ' || p_brand end name from part), single as (select name, min(concept) concept from cn group by 1 having count(*) = 1), kept as (select * from single where concept in (select concept from single group by 1 having count(*) >= 2))"
_ONT = """ont as (select p_brand identifier, list_sort(list(distinct p_name)) n from part group by 1)"""
_SIDES = """refs as (select doc_id passage_key, 0 o, text from documents),
 preds as (select case when doc_id % 11 = 0 then doc_id + 1000000000 else doc_id end passage_key, case when (case when doc_id % 11 = 0 then doc_id + 1000000000 else doc_id end) % 13 = 0 then 1 else 0 end o,
  case when (case when doc_id % 11 = 0 then doc_id + 1000000000 else doc_id end) % 17 = 0 then text || '.' else text end text from documents where doc_id % 7 <> 0)"""
_WORDN = f"len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> ''))"

_CONV = """pas as (select conv_id, 'conv-' || lpad(conv_id::varchar, 8, '0') || '.xml' path, row_number() over (partition by conv_id order by turn, role, text) - 1 passage_idx, role, text,
  coalesce(sum(length(text) + 1) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0)::bigint o from conversations where text is not null)"""
_NOTES = f"""wr as (select path, conv_id, passage_idx, o, unnest(regexp_extract_all(text, '{_W2}', 1)) gap, unnest(regexp_extract_all(text, '{_W2}', 2)) token, unnest(range(len(regexp_extract_all(text, '{_W2}', 2)))) pos from pas),
 wp as (select *, cast(sum(length(gap) + length(token)) over (partition by path, passage_idx order by pos) as bigint) e from wr),
 notes as (select path, conv_id, passage_idx, o, e - length(token) s, e, token, case when token like '%ing' then 'ing' else 'tion' end kind, row_number() over (partition by path order by passage_idx, e) n from wp where regexp_matches(token, '(ing|tion)$'))"""
_GRID = f"""pred2 as (select passage_key, "type", id, r, 'CL:' || (id + r - 3) pred_id, id + case when id % 4 = 0 then 1 else 0 end loc from ids, range(12) t(r) where (id + r) % 9 <> 0),
 placed2 as (select *, row_number() over (partition by passage_key, id order by r) - 1 place from pred2), k(top) as (values (1), (5), (10)), gates as (select distinct gate from gold),
 g1 as (select distinct 'gold_mention_normalize' score_mode, gate, top, passage_key, "type", 0::bigint loc, gold_id i from gold, k union all select distinct 'end_to_end', gate, top, passage_key, "type", id, gold_id from gold, k),
 p1 as (select distinct 'gold_mention_normalize' score_mode, g.gate, top, p.passage_key, p."type", 0::bigint loc, p.pred_id i from placed2 p join (select distinct gate, id, passage_key from gold) g on g.id = p.id and g.passage_key = p.passage_key join k on p.place < top
  union all select distinct 'end_to_end', gate, top, passage_key, "type", loc, pred_id from placed2 join k on place < top, gates),
 b1 as (select coalesce(g1.score_mode, p1.score_mode) score_mode, coalesce(g1.gate, p1.gate) gate, coalesce(g1.top, p1.top) top, coalesce(g1."type", p1."type") kind, g1.gate is not null r, p1.gate is not null q from g1 full join p1 on g1.score_mode = p1.score_mode and g1.gate = p1.gate and g1.top = p1.top
  and g1.passage_key = p1.passage_key and g1."type" = p1."type" and g1.loc = p1.loc and g1.i = p1.i),
 sets(type_set, kinds) as (values ('all', null), ('sizes', ['LARGE', 'MEDIUM', 'SMALL'])),
 c1 as (select type_set, score_mode, gate, top::bigint top, count(*) filter (r and q) tp, count(*) filter (q and not r) fp, count(*) filter (r and not q) fn from b1 join sets on kinds is null or list_contains(kinds, kind) group by 1, 2, 3, 4)"""
_LOSS = """c as (select label from (select label from embeddings group by 1 having count(*) >= 4) order by (label::bigint * 2654435761) % 1000003, label limit 8),
 s as (select *, row_number() over (partition by label order by (vec_id * 2654435761 + 40503) % 1000003, vec_id) pick from embeddings where label in (select label from c) qualify pick <= 4),
 pr as (select a.vec_id i, a.label = b.label same, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) / 0.05 x from s a join s b on a.vec_id <> b.vec_id),
 an as (select i, max(x) m, sum(case when same then x end) pos, sum(same::int) n from pr group by 1),
 l as (select an.i, an.pos, an.n, an.m, ln(sum(exp(pr.x - an.m))) lse from pr join an on an.i = pr.i group by all)"""

_FEATURES = f"""{_words()}, {_ENT}, {_OWN.format('')}, n as (select doc_id, count(*) n from words group by 1), st as (select doc_id, n, unnest(range(0, greatest(n - 32, 1), 94)) f from n),
 wt as (select st.doc_id, f // 94 chunk, w.pos, w.s, w.e, lower(w.token) t, g.tag from st join words w on w.doc_id = st.doc_id and w.pos >= f and w.pos < least(f + 126, n) join tagged g on g.doc_id = w.doc_id and g.pos = w.pos),
 nb as (select *, coalesce(lag(t) over (partition by doc_id, chunk order by pos), '^') p, coalesce(lead(t) over (partition by doc_id, chunk order by pos), '$') x from wt),
 fe as (select doc_id, chunk, pos, s, e, tag, unnest(['w:' || t, 's:' || right(t, 3), 'p:' || p, 'n:' || x]) f from nb)"""
_SCORED = """lab(k, tag) as (values (0, 'O'), (1, 'B-ing'), (2, 'I-ing'), (3, 'B-tion'), (4, 'I-tion')), al as (select count(*) n from wt),
 nl as (select k, lab.tag, count(wt.tag) c from lab left join wt on wt.tag = lab.tag group by 1, 2), ff as (select f, count(*) n from fe group by 1 having count(*) >= 5 order by n desc, f limit 200000),
 fl as (select f, tag, count(*) c from fe group by 1, 2),
 we as (select ff.f, k, floor(1000 * ln((coalesce(fl.c, 0) + 1)::double / (ff.n + 5))) v from ff cross join nl left join fl on fl.f = ff.f and fl.tag = nl.tag),
 sc as (select doc_id, chunk, pos, s, e, k, sum(v) v from fe join we using (f) group by all),
 se as (select w.doc_id, w.pos, w.s, w.e, nl.k, nl.tag, avg(floor(1000 * ln((nl.c + 1)::double / (al.n + 5))) + coalesce(sc.v, 0)) m from wt w cross join nl cross join al
  left join sc on sc.doc_id = w.doc_id and sc.chunk = w.chunk and sc.pos = w.pos and sc.k = nl.k group by all),
 be as (select doc_id, pos, s, e, arg_min(tag, k) filter (m = top) tag from (select *, max(m) over (partition by doc_id, pos) top from se) group by all),
 la as (select *, case when tag = 'O' then null else substring(tag, 3) end label from be),
 op as (select *, sum(case when label is not null and (tag like 'B-%' or before is null or before <> label) then 1 else 0 end) over (partition by doc_id order by pos) g from (select *, lag(label) over (partition by doc_id order by pos) before from la)),
 sp as (select doc_id, min(label) label, min(s) s, max(e) e, count(*) n_tokens from op where label is not null group by doc_id, g)"""

def _draw(x: str, *salts) -> str:
    m = f"({x} % 2147483647)"
    for salt in salts:
        m = f"(({m} * 48271 + {salt} * 69621 + 11) % 2147483647)"
    return f"(({m} * 40692 + 1) % 2147483647)"


_NOTED = "noted as (select conv_id, turn, conv_id || '/' || turn path, role, text, regexp_extract(text, '^([A-Za-z]*)', 1) w, length(regexp_extract(text, '^([A-Za-z]*)', 1)) n from conversations where length(text) > 0)"

_RERANK = f"""with n as (select distinct p_brand identifier, p_name name from part), q as (select distinct p_name query from part),
      c as (select query, identifier, min(name) filter (true) any_name, max(len(list_intersect(string_split(query, ' '), string_split(name, ' ')))) m from q, n group by 1, 2),
      s as (select query, identifier, (select count(*) from (select distinct w from (select unnest(string_split(name, ' ')) w from n where n.identifier = c.identifier) where list_contains(string_split(c.query, ' '), w))) shared from c where m > 0),
      f as (select s.query, s.identifier, -s.shared / 10.0::double emb, (select min(name) from n where n.identifier = s.identifier) lab, max(case when {_normal('query')} = {_normal('n.name')} then 1 else 0 end)::double exact,
        max({_jaccard(_set('query'), _set('n.name'))}) name_jaccard, max(case when {_paren('query', 'n.name')} then 1 else 0 end)::double parenthetical from s join n on n.identifier = s.identifier group by s.query, s.identifier, s.shared),
      g as (select *, {_jaccard(_set('query'), _set('lab'))} label_jaccard, emb + 0.35 * exact + 0.2 * name_jaccard + 0.15 * {_jaccard(_set('query'), _set('lab'))} + 0.1 * parenthetical + case when query = lab then 0.03 else 0 end final from f)"""

_SUITE = f"""{_words()}, gw as (select doc_id pk, pos id, case when token like '%ing' then 'ing' else 'tion' end kind, s, e, e - s n from words where regexp_matches(token, '(ing|tion)$')),
 pw as (select doc_id pk, pos id, case when token like '%ing' then 'ing' else 'tion' end kind, case when pos % 3 = 0 then greatest(s - 4, 0) else s end s, e, e - s n, lower(token) t from words where regexp_matches(token, '(ing|ion)$') and length(token) >= 6),
 gl as (select 'singleID' gate, pk, id, kind, s, e, 'CL:' || n link from gw where id % 5 in (0, 1, 4) union all select 'exactIDsOnly', pk, id, kind, s, e, 'CL:' || n from gw where id % 5 in (0, 4)
  union all select 'allLabels', pk, id, kind, s, e, 'CL:' || n from gw where id % 5 <> 3 union all select 'allLabels', pk, id, kind, s, e, 'CL:' || (n + 1) from gw where id % 5 = 2),
 gates(gate) as (values ('singleID'), ('exactIDsOnly'), ('allLabels')), models(model) as (values ('a'), ('b')), tops(top) as (values (1), (3), (5)), sets(type_set, kinds) as (values ('both', ['ing', 'tion']), ('ing', ['ing'])),
 pl as (select *, row_number() over (partition by pk, id, model order by r) - 1 place from (select pw.*, model, r, 'CL:' || (n + case model when 'a' then r - 1 else -r end) link from pw, range(5) x(r), models where (id + r) % 7 <> 0)),
 g1 as (select distinct 'gold_mention_normalize' score_mode, gate, pk, kind, 0::bigint s, 0::bigint e, link from gl union all select distinct 'end_to_end', gate, pk, kind, s, e, link from gl),
 p1 as (select distinct 'gold_mention_normalize' score_mode, model, a.gate, top, pl.pk, kind, 0::bigint s, 0::bigint e, link from pl join (select distinct gate, pk, id from gl) a on a.pk = pl.pk and a.id = pl.id join tops on place < top
  union all select distinct 'end_to_end', model, gate, top, pk, kind, s, e, link from pl join tops on place < top, gates),
 np as (select score_mode, model, gate, top, kind, count(*) n from p1 group by all), nr as (select score_mode, gate, kind, count(*) n from g1 group by all),
 nm as (select p1.score_mode, model, p1.gate, top, p1.kind, count(*) n from p1 join g1 on p1.score_mode = g1.score_mode and p1.gate = g1.gate and p1.pk = g1.pk and p1.kind = g1.kind and p1.s = g1.s and p1.e = g1.e and p1.link = g1.link group by all),
 nodes as (select model, gate, top, pk, kind, link, id, 1 k, s, e from gl, models, tops union all select model, gate, top, pk, kind, link, id, 0, s, e from pl join tops on place < top, gates where t <> 'being'),
 edges as (select *, case when lag(k) over o <> k and lag(s) over o < e and s < lag(e) over o then 0 else 1 end opens from nodes window o as (partition by model, gate, top, pk, kind, link order by id, k)),
 paths as (select *, sum(opens) over (partition by model, gate, top, pk, kind, link order by id, k) path from edges),
 rm as (select model, gate, top, kind, sum(n // 2)::bigint n from (select model, gate, top, kind, pk, link, path, count(*) n from paths group by all) group by all),
 full_ as (select m.model, g.gate, t.top, w.score_mode, kinds.kind, coalesce(np.n, 0) np, coalesce(nr.n, 0) nr, coalesce(case when w.score_mode = 'relax_end_to_end' then rm.n else nm.n end, 0) m
  from models m, gates g, tops t, (values ('gold_mention_normalize', 'gold_mention_normalize'), ('end_to_end', 'end_to_end'), ('relax_end_to_end', 'end_to_end')) w(score_mode, as_), (values ('ing'), ('tion')) kinds(kind)
  left join np on np.score_mode = w.as_ and np.model = m.model and np.gate = g.gate and np.top = t.top and np.kind = kinds.kind left join nr on nr.score_mode = w.as_ and nr.gate = g.gate and nr.kind = kinds.kind
  left join nm on nm.score_mode = w.as_ and nm.model = m.model and nm.gate = g.gate and nm.top = t.top and nm.kind = kinds.kind left join rm on rm.model = m.model and rm.gate = g.gate and rm.top = t.top and rm.kind = kinds.kind),
 c as (select model, gate, type_set, score_mode, top::bigint top, sum(m)::bigint tp, sum(np - m)::bigint fp, sum(nr - m)::bigint fn from full_, sets where list_contains(kinds, kind) group by all)"""
_RANKS = f"""x as (select path, passage_idx, kind, token, n, length({_singular('token')}) z from notes),
 g as (select distinct path, passage_idx, kind, 'CL:' || (length(token) + n % 12) i from x), p as (select distinct top, path, passage_idx, kind, 'CL:' || (z + r) i from x, range(10) q(r), (values (1), (5), (10)) k(top) where z % 3 <> 0 and r < top),
 c as (select top::bigint top, (select count(*) from p join g on p.path = g.path and p.passage_idx = g.passage_idx and p.kind = g.kind and p.i = g.i where p.top = k.top) tp, (select count(*) from p where p.top = k.top) np, (select count(*) from g) ng from (values (1), (5), (10)) k(top)),
 d as (select top, tp, np - tp fp, ng - tp fn from c)"""

SQL = {
    "passage_scan_filter": "select doc_id, source, row_number() over (partition by source order by doc_id) - 1 record_id, length(text) n from documents where length(text) > 0",
    "passage_running_id": "select doc_id, row_number() over (order by doc_id) - 1 id from documents where length(text) > 0",
    "corpus_stats": f"select lang, source, count(distinct doc_id) n_docs, count(*) n_passages, sum(length(text))::bigint n_chars, sum({_WORDN})::bigint n_tokens from documents group by 1, 2",
    "corpus_throughput": f"select lang, round(2000.0::double / count(distinct doc_id), 6) ms_per_doc, round(2000.0::double / count(*), 6) ms_per_passage, round(2000000.0::double / sum({_WORDN}), 6) ms_per_1k_tokens, round(sum(length(text)) / 2.0::double, 6) chars_per_s from documents group by 1",
    "token_totals": f"select role, sum(len({_tokens('text')}))::bigint n_tokens, count(*) n_rows from conversations group by 1",
    "concat_collections": "select 'documents' \"file\", doc_id id, md5(text) digest from documents union all select 'benchmark', item_id, md5(text) from benchmark",
    "rebuild_document": "select conv_id, md5(string_agg(text, chr(10) order by turn, text)) digest from conversations group by 1",
    "token_split": f"select doc_id, len({_tokens('text')}) n, md5(array_to_string({_tokens('text')}, '|')) digest from documents",
    "plural_normalize": f"select doc_id, length({_plural('text')}) n, md5({_plural('text')}) digest from documents",
    "text_keys": f"with d as (select p_partkey, p_name, upper(substring(p_name, 1, 3)) || '-' || p_brand || '  s' x from part) select p_partkey, {_normal('x')} normal, {_key('x')} abbr_key, {_key('x')} || '|' || ({_other(_key('x'))}) variants, {_limit('x')} threshold, {_short('x')} looks_short, {_short('p_name')} name_looks_short from d",
    "relaxed_key": f"with d as (select p_partkey id, '(“' || p_name || '’s”—A_Cells).' x from part union all select n_nationkey, n_name || 'ies' from nation), r as (select id, string_split({_relaxed('x')}, ' ') a from d), l as (select id, a, a[-1] w from r) select id, array_to_string(list_append(a[1:len(a) - 1], {_LAST}), ' ') relaxed from l",
    "identifier_split": f"with {_IDS}, d as (select id, x, {_PARTS} p from ids) select id, unnest(case when len(p) = 0 then [null] else p end) part, regexp_replace(x, '^(?i)cl[_:]', 'CL:') cased, array_to_string(list_transform(regexp_extract_all(x, '(?i)CL\\s*[:_]\\s*(\\d+)', 1), lambda k: 'CL:' || k), '|') found from d",
    "identifier_gates": f"with {_IDS}, {_GOLD} select gate, \"type\", count(*) n, count(distinct gold_id) n_ids from gold group by 1, 2",
    "token_jaccard_pairs": f"with n as (select distinct p_name from part) select a.p_name a, b.p_name b, round({_jaccard(_set('a.p_name'), _set('b.p_name'))}, 9) jaccard from n a, n b where a.p_name < b.p_name and len(list_intersect({_set('a.p_name')}, {_set('b.p_name')})) > 0",
    "parenthetical_relation": f"with d as (select p_partkey, p_name, p_brand || ' (' || upper(p_name) || ')' f, '(' || p_brand || ')' o from part) select p_partkey, {_paren('p_name', 'f')} related, {_paren('p_name', 'o')} unrelated from d",
    "byte_offset_map": "with c as (select doc_id, unnest(string_split(text, '')) c, unnest(range(length(text))) i from documents where text <> ''), o as (select doc_id, i + 1 i, sum(strlen(c)) over (partition by doc_id order by i)::bigint b from c union all select doc_id, 0, 0 from documents) select o.doc_id, length(any_value(d.text)) n, md5(string_agg(b::varchar, ',' order by i)) digest from o join documents d on d.doc_id = o.doc_id group by 1",
    "passage_keys": "with d as (select conv_id, turn, case when conv_id % 5 = 0 then '' else conv_id::varchar end doc, case when turn % 3 = 0 then 'p' || turn else '' end p, case when turn % 2 = 0 then 'a' || conv_id else '' end a from conversations) select conv_id, turn, coalesce(nullif(p, ''), nullif(a, ''), doc || ':' || turn) passage_key, case when conv_id % 2 = 0 then 'a/b.xml::' else '' end || coalesce(nullif(p, ''), coalesce(nullif(doc, ''), 'unknown_document') || ':' || turn) sourced_key, coalesce(nullif(doc, ''), nullif(a, ''), nullif(p, '')) document_key from d",
    "json_entities_parse": f"with {_words()}, {_SPANS}, g as (select g.*, w.token from gold g join words w on w.doc_id = g.passage_key and w.pos = g.id) select d.doc_id, count(g.id) n, md5(coalesce(string_agg(g.s || ':' || g.e || ':' || g.\"type\" || ':' || g.token, ',' order by g.s), '')) digest from documents d left join g on g.passage_key = d.doc_id group by 1",
    "ontology_terms": f"with {_ONT}, d as (select identifier, n[1] preferred_label, unnest(n) raw_name, unnest(range(len(n))) ord from ont) select identifier, preferred_label, raw_name, {_plural('raw_name')} name, ord = 0 is_preferred, ord from d",
    "concept_metadata": f"with {_ONT} select identifier, n[1] preferred_label, len(n) n_names, array_to_string(n, '|') names from ont",
    "abbrev_lookup": f"with {_ABBR} select k \"key\", n_ids, n_rows, short_form, identifier from lookup",
    "abbrev_exact_join": f"with {_ABBR}, {_MENTIONS}, m as (select distinct mention from mentions) select mention, k \"key\", n_ids, short_form, identifier from m join lookup on k = {_key('mention')} where {_short('mention')}",
    "doc_shortform_cascade": f"with {_MENTIONS}, {_DEFINED}, {_CASCADE} select doc_key, k \"key\", \"method\", matched_key, long_form from cascade",
    "abbrev_resolve": f"with {_ABBR}, {_MENTIONS}, {_DEFINED}, {_CASCADE}, {_RESOLVE} select * from resolved",
    "decision_counters": f"with {_ABBR}, {_MENTIONS}, {_DEFINED}, {_CASCADE}, {_RESOLVE} select kind source, count(*) n from resolved group by 1",
    "link_topk_terms": f"with {_NEAR} select query_id, vec_id, distance, \"rank\" from top",
    "link_topk_indexed": f"with {_NEAR} select query_id, vec_id, distance, \"rank\" from top",
    "link_topk_concepts": f"with {_NEAR}, one as (select *, row_number() over (partition by query_id, label order by distance, vec_id) n from top qualify n = 1) select query_id, label, vec_id, distance, k \"rank\" from (select query_id, label, vec_id, distance, row_number() over (partition by query_id order by distance, vec_id) k from one) where k <= 5",
    "abbrev_nearest_key": f"with q as (select vec_id, list_transform(embedding, lambda x, i: case when i % 8 = 1 then x * 0.5::float else x end) embedding from embeddings where vec_id % 50 = 0), near as (select q.vec_id, t.vec_id key_id, t.label::bigint n_ids, round({_COS.format('q', 't')}, 9) distance from q, embeddings t), one as (select *, row_number() over (partition by vec_id order by distance, key_id) n from near qualify n = 1), m as (select left('ABCDEFGHIJK', (3 + vec_id % 8)::int) mention, vec_id, key_id, n_ids, round(1 - distance, 9) score from one) select * from m where score >= case when length(mention) <= 4 then 2 when length(mention) <= 7 then 0.95 else 0.9 end",
    "cosine_pairs": f"select q.vec_id query_id, t.vec_id, round({_COS.format('q', 't')}, 9) distance from embeddings q, embeddings t where q.vec_id % 50 = 0",
    "rerank_candidates": f"""{_RERANK} select query, identifier, round(exact, 9) exact, round(name_jaccard, 9) name_jaccard, round(label_jaccard, 9) label_jaccard, round(parenthetical, 9) parenthetical, round(final, 9) final_score from g""",
    "rerank_ranks": f"with r as ({_RERANK} select * from g) select query, identifier, row_number() over (partition by query order by final desc, emb desc, identifier) \"rank\" from r",
    "mention_distinct": f"with {_words()} select lower(token) norm, count(*) n, count(distinct doc_id) n_docs from words group by 1",
    "mention_link_join": f"with {_words()}, {_GAZ} select doc_id, count(*) n_mentions, count(concept) n_linked, count(distinct concept) n_concepts from words left join gaz on lower(token) = term group by 1",
    "chunk_windows": f"with d as (select doc_id, len({_tokens('text')}) n from documents), s as (select doc_id, n, unnest(range(0, greatest(n - 128, 1), 382)) \"first\" from d) select doc_id, \"first\" // 382 chunk, \"first\", least(\"first\" + 510, n) \"last\" from s",
    "logit_average": f"with {_LOGITS} select token, label, round(m, 9) mean_logit, n n_chunks from means",
    "logit_argmax": f"with {_LOGITS}, r as (select *, row_number() over (partition by token order by m desc, label) k from means) select token, label from r where k = 1",
    "bio_decode": """with d as (select user_id, ts, event_id, case when event_id % 4 = 0 then 'O' when event_id % 5 = 0 then 'B-' || event_type else 'I-' || event_type end tag, event_id * 2 s, event_id * 2 + 1 e from events where event_id % 11 <> 0),
      l as (select *, case when tag = 'O' then null else substring(tag, 3) end label from d), p as (select *, lag(label) over (partition by user_id order by ts, event_id) before from l),
      g as (select *, sum(case when label is not null and (tag like 'B-%' or before is null or before <> label) then 1 else 0 end) over (partition by user_id order by ts, event_id) n from p)
      select user_id, min(label) label, min(s) "start", arg_max(e, (ts, event_id)) "end", count(*) n_tokens from g where label is not null group by user_id, n""",
    "bio_encode": f"with {_words()}, {_ENT}, {_OWN.format('')} select doc_id, tag, count(*) n, sum(pos)::bigint pos_sum from tagged group by 1, 2",
    "bio_encode_skip": f"with {_words()}, {_ENT}, {_OWN.format(_SKIP)} select doc_id, tag, count(*) n, sum(pos)::bigint pos_sum from tagged group by 1, 2",
    "chunk_labels": f"""with {_words()}, {_ENT}, {_OWN.format('')}, n as (select doc_id, count(*) n from tagged group by 1), s as (select doc_id, n, unnest(range(0, greatest(n - 32, 1), 94)) f from n),
      c as (select doc_id, f // 94 chunk, f, least(f + 126, n) l from s) select c.doc_id, c.chunk, (sum(case t.tag when 'O' then 0 when 'B-ing' then 1 when 'I-ing' then 2 when 'B-tion' then 3 else 4 end) - 200)::bigint label_sum, count(*) + 2 n
      from c join tagged t on t.doc_id = c.doc_id and t.pos >= c.f and t.pos < c.l group by 1, 2""",
    "recognize_windows": f"with {_FEATURES}, {_SCORED} select sp.doc_id, label, s \"start\", e \"end\", n_tokens, md5(substring(text, s::int + 1, (e - s)::int)) digest from sp join documents d on d.doc_id = sp.doc_id",
    "label_schema": "with t as (select distinct event_type x from events where event_type is not null), n as (select x, row_number() over (order by x) k from t) select 0 label_id, 'O' label union all select 2 * k - 1, 'B-' || x from n union all select 2 * k, 'I-' || x from n",
    "label_recode": "select case when event_type = 'click' then 'view' else event_type end event_type, count(*) n from events where event_type <> 'purchase' group by 1",
    "balanced_sample": "with c as (select label from (select label from embeddings group by 1 having count(*) >= 3) order by (label::bigint * 2654435761) % 1000003, label limit 5) select label, vec_id, row_number() over (partition by label order by (vec_id * 2654435761 + 40503) % 1000003, vec_id) pick from embeddings where label in (select label from c) qualify pick <= 3",
    "label_index": "with l as (select label, count(*) n from embeddings group by 1 having count(*) >= 3), i as (select *, row_number() over (order by label) - 1 label_id from l), p as (select label, vec_id, row_number() over (partition by label order by vec_id) pos from embeddings) select label_id, label::bigint label, n, sum(pos * vec_id)::bigint mark from i join p using (label) group by 1, 2, 3",
    "batch_plan": f"""with l as (select label, count(*) n, row_number() over (order by label) - 1 label_id from embeddings group by 1 having count(*) >= 3),
      o as (select *, row_number() over (order by {_draw('label_id', 43)}, label_id) - 1 place, count(*) over () m from l),
      r as (select label_id, vec_id, n, e.label, row_number() over (partition by e.label order by {_draw('vec_id', 43)}, vec_id) - 1 pos from embeddings e join l on e.label = l.label),
      b as (select b batch, k, {_draw('b', 43, 1)} a, {_draw('b', 43, 2)} t from range(200) x(b), range(4) y(k)),
      q as (select b.batch, o.label_id, o.n, b.batch * 1000003 + o.label_id z from b join o on o.place = (a + k * (1 + t % ((m - 1) // 3))) % m),
      p as (select q.batch, q.label_id, ({_draw('z', 43, 3)} + j * (1 + {_draw('z', 43, 4)} % ((n - 1) // 2))) % n pos from q, range(3) w(j))
      select batch, row_number() over (partition by batch order by {_draw('vec_id', 43, 'batch', 5)}, vec_id) - 1 slot, label::bigint label, vec_id from p join r on r.label_id = p.label_id and r.pos = p.pos""",
    "span_overlap_pairs": f"with {_words()}, {_SPANS}, b as (select passage_key, 2 * id i, s, e from pred union all select passage_key, 2 * id + 1, s, e from gold) select x.passage_key, count(*) n, sum(x.i * 3 + y.i)::bigint mark from b x join b y on x.passage_key = y.passage_key and x.i < y.i and x.s < y.e and y.s < x.e group by 1",
    "span_containment_join": f"with {_words()}, {_SPANS} select passage_key doc_id, id, s // 400 passage, s % 400 local_start from gold where s // 400 = (e - 1) // 400",
    "span_token_overlap_join": f"with {_words()}, {_SPANS} select g.passage_key, count(*) n, sum(g.id * 3 + p.id)::bigint mark from gold g join pred p on g.passage_key = p.passage_key and g.\"type\" = p.\"type\" and g.s < p.e and p.s < g.e where exists (select 1 from words t where t.doc_id = g.passage_key and g.s < t.e and t.s < g.e and p.s < t.e and t.s < p.e) group by 1",
    "strict_span_prf": f"with {_words()}, {_SPANS}, r as (select distinct passage_key, \"type\", s, e from gold), p as (select distinct passage_key, \"type\", s, e from pred), c as (select (select count(*) from (select * from r intersect select * from p)) tp, (select count(*) from (select * from p except select * from r)) fp, (select count(*) from (select * from r except select * from p)) fn) select *, {_PRF} from c",
    "link_prf_topk": f"""with {_IDS}, {_GOLD}, {_PRED.format('')}, k(top) as (values (1), (5), (10)), g as (select distinct top, passage_key, "type", gold_id id from gold, k where gate = 'allLabels'), p as (select distinct top, passage_key, "type", pred_id id from placed, k where place < top),
      c as (select top, (select count(*) from (select * from g where g.top = k.top intersect select * from p where p.top = k.top)) tp, (select count(*) from p where p.top = k.top) np, (select count(*) from g where g.top = k.top) ng from k), d as (select top, tp, np - tp fp, ng - tp fn from c) select *, {_PRF} from d""",
    "link_prf_grid": f"""with {_IDS}, {_GOLD}, {_PRED.format('and 99 - r * 7 >= 50')}, gates as (select distinct gate from gold), g as (select distinct gate, "type", passage_key, gold_id i from gold), p as (select distinct gate, "type", passage_key, pred_id i from placed, gates where place < 5),
      b as (select coalesce(g.gate, p.gate) gate, coalesce(g."type", p."type") "type", g.gate is not null r, p.gate is not null q from g full join p on g.gate = p.gate and g."type" = p."type" and g.passage_key = p.passage_key and g.i = p.i),
      c as (select gate, "type", count(*) filter (r and q) tp, count(*) filter (q and not r) fp, count(*) filter (r and not q) fn from b group by 1, 2) select *, {_PRF} from c""",
    "document_definitions": f"select p_partkey, {_PREFIX.format('').replace('left(w, 2)', 'left(w, 1)')} \"key\", p_name long_form, 0::bigint ord from part",
    "doc_shortform_fuzzy": f"with {_MENTIONS}, {_DEFINED}, {_CASCADE} select doc_key, k \"key\", \"method\", matched_key, long_form, 1.0::double score from cascade",
    "relaxed_span_prf": f"""with {_words()}, {_SPANS}, nodes as (select passage_key, id, 1 k, "type", s, e from gold union all
        select p.passage_key, p.id, 0, p."type", p.s, p.e from pred p join words w on w.doc_id = p.passage_key and w.pos = p.id where lower(w.token) not in ('the', 'being')),
      linked as (select *, case when lag(k) over o <> k and lag("type") over o = "type" and lag(s) over o < e and s < lag(e) over o then 0 else 1 end opens from nodes window o as (partition by passage_key order by id, k)),
      paths as (select passage_key, sum(opens) over (partition by passage_key order by id, k) path from linked), sizes as (select count(*) n from paths group by passage_key, path),
      d as (select sum(n // 2) tp from sizes), c as (select tp::bigint tp, ((select count(*) from pred) - tp)::bigint fp, ((select count(*) from gold) - tp)::bigint fn from d) select *, {_PRF} from c""",
    "contrastive_loss": f"with {_LOSS} select round(avg(-(pos / n - m - lse)), 6) loss, count(*) anchors from l where n > 0",
    "xml_passages": f"with {_CONV} select path, conv_id::varchar doc_id, passage_idx, o passage_offset, role \"type\", md5(text) digest from pas where text <> ''",
    "xml_corpus_counts": f"with {_CONV}, {_NOTES} select path, count(distinct conv_id) n_docs, count(*) n_passages, sum(length(text))::bigint n_chars, sum({_WORDN})::bigint n_tokens, (select count(*) from notes n where n.path = p.path) n_mentions from pas p where text <> '' group by path",
    "xml_concatenate": f"with {_CONV} select '1' place, md5(conv_id::varchar) digest from pas group by conv_id union all select '0', md5('<collection><source>made</source>') union all select '2', md5('</collection>')",
    "xml_spans_write": f"with {_CONV}, {_NOTES} select path, 'T' || n ann_id, kind \"type\", passage_idx, o + s \"offset\", length(token)::bigint \"length\", token \"text\" from notes",
    "xml_by_document": f"with {_CONV}, {_NOTES} select conv_id::varchar doc_id, kind \"type\", passage_idx, o + s \"offset\", length(token)::bigint \"length\", token \"text\" from notes",
    "xml_entities": f"with {_CONV}, {_NOTES} select path, 'T' || n || ':0' entity_id, s \"start\", e \"end\", token surface from notes",
    "xml_links_write": f"with {_CONV}, {_NOTES}, x as (select *, {_singular('token')} w from notes) select p.path, count(w) filter (length(w) % 2 = 0) matched, count(w) filter (length(w) % 2 = 1) missing, count(distinct length(w)) filter (length(w) % 2 = 0) n_ids, min(w) filter (length(w) % 2 = 0) least_name from (select distinct path from pas) p left join x on x.path = p.path group by 1",
    "training_records": f"with {_CONV}, {_NOTES} select row_number() over (order by p.path, p.conv_id::varchar, p.passage_idx) - 1 id, p.conv_id::varchar document_id, p.passage_idx passage_id, p.o passage_offset, count(n.token) n, md5(coalesce(string_agg(n.s || ':' || n.e || ':' || case n.kind when 'ing' then 'act' else n.kind end || ':' || n.token, ',' order by n.n), '')) digest from pas p left join notes n on n.path = p.path and n.passage_idx = p.passage_idx where p.text <> '' group by p.path, p.conv_id, p.passage_idx, p.o",
    "evaluate_link_grid": f"with {_IDS}, {_GOLD}, {_GRID} select *, {_PRF} from c1",
    "evaluate_link_suite": f"with {_SUITE} select *, {_PRF} from c",
    "link_ranks_round_trip": f"with {_CONV}, {_NOTES}, {_RANKS} select *, {_PRF} from d",
    "verify_passages": f"with {_SIDES} select passage_key, 'missing' problem from refs where passage_key not in (select passage_key from preds) union all select passage_key, 'extra' from preds where passage_key not in (select passage_key from refs) union all select r.passage_key, case when r.o <> p.o then 'offset' else 'text' end from refs r join preds p on r.passage_key = p.passage_key where r.o <> p.o or r.text <> p.text",
    "drop_unknown_passages": f"with {_SIDES} select passage_key, o \"offset\" from preds where passage_key in (select passage_key from refs)",
    "term_dedupe": f"with {_TERMS} select * from terms",
    "training_pairs": f"with {_TERMS} select a.concept, a.term left_term, b.term right_term from terms a join terms b on a.concept = b.concept and a.pos < b.pos",
    "ambiguous_name_filter": f"with {_CN} select concept, name from kept",
    "ambiguous_name_statistics": f"with {_CN} select (select count(distinct concept) from cn) concepts_before, (select count(*) from cn) names_before, (select count(distinct concept) from kept) concepts_after, (select count(*) from kept) names_after, (select count(*) from (select name from cn group by 1 having count(*) > 1)) ambiguous_names, (select count(distinct concept) from cn) - (select count(distinct concept) from kept) concepts_dropped",
    "corpus_overlap": f"with {_words()}, {_GAZ}, f as (select distinct d.lang corpus, lower(w.token) form from words w join documents d on w.doc_id = d.doc_id) select corpus, count(*) n_forms, count(term) n_matched, round(100.0::double * count(term) / count(*), 2) percent from f left join gaz on form = term group by 1",
    "file_datasets": "select doc_id, lang, md5(text) digest from documents",
    "file_predictions": f"with {_words()}, {_SPANS} select passage_key::varchar document_id, \"type\" label, s + 7 \"start\", e + 7 \"end\" from gold",
    "file_training_pairs": f"with {_TERMS}, p as (select a.concept, a.term x, b.term y from terms a join terms b on a.concept = b.concept and a.pos < b.pos) select concept, x \"name\" from p union select concept, y from p",
    "file_dictionary": f"with {_TERMS} select term, concept from terms",
    "file_abbreviations": f"with {_ABBR} select k \"key\", n_ids, n_rows from lookup",
    "file_ontology": f"with {_ONT}, d as (select identifier, unnest(n) raw_name, unnest(range(len(n))) ord from ont) select identifier, raw_name, {_plural('raw_name')} \"name\", ord = 0 is_preferred, ord from d",
    "file_ontology_tolerant": f"with {_ONT}, r as (select unnest(n) x from ont where right(identifier, 1) not in ('3', '4')), l as (select string_split({_relaxed('x')}, ' ') a from r), m as (select a, a[-1] w from l) select distinct array_to_string(list_append(a[1:len(a) - 1], {_LAST}), ' ') form from m",
    "file_xml_each": f"with {_CONV}, {_NOTES} select replace(path, '.xml', '.out.xml') \"name\", count(*) n, sum(o + s)::bigint offsets from notes group by 1",
    "xml_corpus_mentions": f"with {_NOTED}, m as (select distinct n, lower(w) t from noted where n % 2 = 0 and n > 0) select 'CL:' || n concept, count(*) n, min(t) least, count(*) n_pos from m group by 1",
    "xml_types": f"with {_NOTED} select 's' || n \"type\", count(*) n from noted where n > 0 group by 1",
    "xml_spans_of": f"with {_NOTED} select path, role \"type\", 5::bigint \"first\", substring(text, 1, (n - 1)::int) || ' ' || substring(text, 5, 1) \"text\" from noted where n > 1 and n <> 3 and length(text) >= greatest(n - 1, 5)",
    "xml_text_units": f"with {_NOTED}, u as (select path, -1 i, 5::bigint o, text t from noted where turn % 4 <> 0 union all select path, 0, 5, left(text, length(text) // 2) from noted where turn % 4 = 0 union all select path, 1, 5 + length(text) // 2, substring(text, length(text) // 2 + 1) from noted where turn % 4 = 0) select path, i::bigint sentence_idx, o unit_offset, md5(t) digest from u where t <> ''",
    "xml_link_mentions": f"with {_NOTED}, m as (select distinct conv_id::varchar doc_key, path, w from noted where n > 0 and n <> 3 and turn % 3 <> 0) select doc_key, count(*) n, min(w) least from m group by 1",
    "entry_names": "with i as (select distinct 'CL:' || p_size identifier from part), d as (select distinct case when p_partkey % 2 = 0 then 'cl_' else 'CL:' end || p_size x, p_size from part), e as (select p_size, min(p_type) n from part where p_size % 3 <> 0 group by 1) select 'CL:' || d.p_size identifier, coalesce(case when x like 'CL:%' then e.n end, e.n, 'CL:' || d.p_size) \"name\" from d left join e using (p_size)",
    "evaluate_link_top": f"with {_SUITE.replace('and 90 - r * 10 >= 50', '').replace('range(5) x(r)', 'range(6) x(r)')}, k as (select * from g1 where score_mode = 'end_to_end' and kind = 'ing'), q as (select * from p1 where score_mode = 'end_to_end' and kind = 'ing' and model = 'a' and top = 5), c5 as (select gate, 5::bigint top, (select count(*) from q join k using (gate, pk, s, e, link) where q.gate = gates.gate) tp, (select count(*) from q where q.gate = gates.gate) np, (select count(*) from k where k.gate = gates.gate) nr from gates), z as (select gate, top, tp, np - tp fp, nr - tp fn from c5) select *, {_PRF} from z",
    "stream_mentions": f"with {_words()}, {_GAZ} select distinct lower(token) mention, coalesce(concept, -1)::bigint concept from words left join gaz on lower(token) = term",
    "annotate_e2e": f"with {_words(pattern=_UNICODE)}, {_GAZ} select doc_id, s \"start\", e \"end\", token \"text\", concept from words join gaz on lower(token) = term",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
