"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables.

The others are held against brute force in the tests: language model, sampling, labelling, packing, ring
and fingerprints need state or functions that SQL lacks; similarity components could be spelled out but not
run on whole tables.
"""

from sparkloom.llm.queries import SPOKEN, URL_RULES
from sparkloom.llm.quality import QualityRules
from sparkloom.llm.secrets import BASE, WEAK

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

_R = QualityRules()
_BLANK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern with their places: running lengths of what lies between them, and of themselves."""
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, {kind} kind, b "start", b + length(h) "end" from (
  select doc_id, hits[i] h, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) b
  from (select doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) i
   from (select doc_id, regexp_extract_all(t, '{pattern}') hits, string_split_regex(t, '{pattern}') gaps from d)))
 where length(regexp_extract(h, '{pattern}', {group})) >= {least}"""


_NAMES = ", ".join(f"'{x[0]}'" for x in BASE + WEAK)
_ROLES = ", ".join(f"'{x[1]}'" for x in BASE + WEAK)
_PARTS = " union all ".join(_spans(k, pattern, group, least) for k, (_, _, pattern, group, least) in enumerate(BASE + WEAK))

def _round(i: int) -> str:
    """CTEs of one round: distances and nearest centroid, then floored means."""
    return f"""s{i} as materialized ({_nearest(i)}),
 n{i} as (select s.c, e.i, count(*) n, sum(e.x)::bigint t from s{i} s join e using (r) group by 1, 2),
 c{i + 1} as materialized (select c.c, c.i, coalesce((t - ((t % n) + n) % n) // n, c.x)::bigint x from c{i} c left join n{i} n using (c, i))"""


def _nearest(i: int) -> str:
    return f"""select r, arg_min(c, (d, c)) c, min(d) d from (select e.r, c.c, sum((e.x - c.x) * (e.x - c.x))::bigint d from e join c{i} c using (i) group by 1, 2) group by 1"""


#: Plain Lloyd rounds, all distances.
_CLUSTERS = f"""with k as (select row_number() over (order by vec_id, embedding) r, vec_id, embedding v from embeddings where len(embedding) = 64
  and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
 e as materialized (select r, unnest(range(1, 65)) i, unnest(list_transform(v, lambda x: floor(1024 * x::double)::bigint)) x from k),
 f as (select r, row_number() over (order by sha256('3:' || vec_id), v) - 1 c from k),
 c0 as materialized (select f.c, e.i, e.x from f join e using (r) where f.c < 8),
 {", ".join(_round(i) for i in range(10))}, s as materialized ({_nearest(10)}),
 h as (select c, sha256(string_agg(x, ',' order by i)) sha from c10 group by 1), t as (select c, sum(d)::bigint own from s group by 1)
 select k.vec_id, s.c::int "cluster", s.d::bigint distance, t.own cluster_inertia, (select sum(own) from t)::bigint inertia, h.sha centroid_sha256
 from s join k using (r) join t using (c) join h using (c)"""

#: Every kept term for every group, every pair of groups.
_DIVERGENCE = r"""with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
 u as (select id, lang, source, unnest(w) term from d),
 o as materialized (select lang, source, term, count(*) n, count(distinct id) df from u group by all),
 kept as materialized (select lang, term from o group by all having sum(df) >= 30),
 g as materialized (select distinct lang, source from d),
 n as materialized (select g.lang, g.source, kept.term, coalesce(o.n, 0) n from g join kept using (lang) left join o using (lang, source, term)),
 ln as (select lang, term, sum(n) n from n group by all),
 p as materialized (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)) p from n),
 q as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * count(*) over (partition by lang)) q from ln),
 x as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) v from p a join p b using (lang, term) where a.source <> b.source group by all),
 r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(x.v, 0)::bigint "value" from g a join g b on a.lang = b.lang and a.source <> b.source
   left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select p.lang, p.source, 'term', p.term, (p - q)::bigint from p join q using (lang, term) where n > 0 and p > q),
 k as (select *, (row_number() over (partition by lang, source, part order by "value" desc, encode(item)))::int "rank" from r)
 select * from k where part = 'pair' or "rank" <= 50"""

_ESC = r"regexp_replace(regexp_replace({}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(INST|ROLE)\])', '[\\\1', 'g')"
_CHATS = f"""with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from (select conv_id, turn, role, text from conversations
  union all values (-1, 0, 'user', '{SPOKEN}'), (-1, 1, 'assistant', '{SPOKEN}'))),
 f as (select *, case r when 'user' then '<s>[INST] ' || {_ESC.format("t")} || ' [/INST]' when 'assistant' then {_ESC.format("t")} || '</s>'
   else '<s>[ROLE]' || {_ESC.format("r")} || '[/ROLE]' || {_ESC.format("t")} || '</s>' end whole from c),
 a as (select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '') lost, sum(length(whole))::bigint formatted_chars from f group by 1)
 select conv_id, n_turns, turns_sha256, length(lost)::bigint loss_chars, sha256(lost) loss_sha256, formatted_chars from a"""

ORACLES: dict[str, str] = {
    "op11_source_divergence": _DIVERGENCE,
    "op12_centroid_clustering": _CLUSTERS,
    "op13_chat_formatting": _CHATS,
    "op4_secret_scans": f"""with d as (select doc_id, coalesce(text, '') t from documents), parts as materialized ({_PARTS}),
 breaks as materialized ({_spans(-1, r"\n\x20*\n\s*", 0, 2)}),
 s as materialized (select p.*, [{_ROLES}][kind + 1] "role", (select count(*) from breaks b where b.doc_id = p.doc_id and b."start" <= p."start") "scope" from parts p),
 n as (select s.*, exists (select 1 from s o where o.doc_id = s.doc_id and o."scope" = s."scope" and abs(o."start" - s."start") <= 300 and o."role" = 'id') ids,
   exists (select 1 from s o where o.doc_id = s.doc_id and o."scope" = s."scope" and abs(o."start" - s."start") <= 300 and o."role" = 'secret') secrets,
   exists (select 1 from s o where o.doc_id = s.doc_id and o.kind < {len(BASE)} and o."end" > s."start" and o."start" < s."end") covered from s),
 f as (select * from n where kind < {len(BASE)} or (not covered and case "role" when 'id' then secrets when 'secret' then ids else ids and secrets end)),
 a as (select doc_id, count(*) filter (kind = 0) x, count(*) filter (kind = 1) y, count(*) filter (kind = 2) z,
   coalesce(string_agg(concat([{_NAMES}][kind + 1], ':', "start", ':', "end"), ',' order by "start", kind) filter (kind < {len(BASE)}), '') base,
   string_agg(concat([{_NAMES}][kind + 1], ':', "start", ':', "end"), ',' order by "start", kind) spans from f group by 1)
 select d.doc_id, coalesce(x, 0)::bigint n_assign, coalesce(y, 0)::bigint n_access, coalesce(z, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (doc_id)""",
    "op8_quality_rules": f"""with d as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
 grams as (select doc_id, i, array_to_string(w[i:i+{_R.window - 1}], ' ') g from (select doc_id, w, unnest(range(1, len(w) - {_R.window - 2})) i from d)),
 twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) n from grams) where n > 1),
 covered as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + {_R.window})) j from twice) group by 1),
 l as materialized (select doc_id, source, md5(t) digest, line, lower(trim(regexp_replace(line, '{_BLANK}', ' ', 'g'), ' ')) norm,
  len(regexp_extract_all(line, '{_WORD}')) n from (select *, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '{_WORD}')),
 bad as (select source, norm from l group by 1, 2 having count(distinct digest) > {_R.max_documents}),
 gone as (select doc_id, sum(n) n from l join bad b on b.norm = l.norm and b.source is not distinct from l.source group by 1),
 dup as (select doc_id, count(*) - count(distinct line) n from l group by 1),
 f as (select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines,
  coalesce(covered.n, 0)::bigint n_repeat_words, coalesce(gone.n, 0)::bigint removed_words
  from d left join dup using (doc_id) left join covered using (doc_id) left join gone using (doc_id)),
 b as (select *, n_words < {_R.min_words} or 100 * n_repeat_words > {_R.max_repeat_percent} * n_words base_failed from f)
 select *, not base_failed and not (100 * removed_words > {_R.max_removed_percent} * n_words and n_words - removed_words < {_R.min_words}) kept from b""",
    "op2_url_filters": f"""with p as (select page_id, coalesce(url, '') u from pages),
 r as (select page_id, case when position('://' in u) > 0 then substr(u, position('://' in u) + 3) else '' end r from p),
 h as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(regexp_replace(r, '^[^/?#]*', ''), '^[^?#]*') path from r),
 rules(verdict, rh, rp) as (values {_RULES}),
 m as (select page_id, rh || rp "rule", verdict, row_number() over (partition by page_id order by length(rh || rp) desc) k
  from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
 select h.page_id, host, path, "rule", coalesce(verdict, 'allow') verdict from h left join (select * from m where k = 1) m using (page_id)""",
}
